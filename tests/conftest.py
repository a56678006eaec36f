import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from exposure.session import build_session

    session = build_session(
        "exposure-tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Builds a DataFrame from dicts and a DDL schema."""

    def build(data, schema):
        names = [f.split()[0] for f in schema.replace("\n", " ").split(", ")]
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in data], schema)

    return build


@pytest.fixture
def plan_of(capsys):
    """The physical plan of a DataFrame as text."""

    def text(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return text


HOST = "scan_id int, ip string, mac string, hostname string, status string, os_name string, os_accuracy int"
PORT = "scan_id int, ip string, port int, proto string, state string, svc string, product string, version string, cpe string"
FINDING = (
    "scan_id int, ip string, finding_ord bigint, plugin_id int, plugin_name string, severity int, severity_label string, "
    "cvss double, cvss3 double, exploit_available boolean, cves array<string>, port int, proto string"
)
TAG = "asset_key string, labels array<string>, owner string, notes string, last_ip string, last_seen timestamp"
VULN = "cpe string, ord bigint, cve string, cvss double, severity string, descr string"
