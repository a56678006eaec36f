"""Schemas of the files read. XML attributes are strings and cast later.

A number that does not parse (``rtt="--"``) would null the whole enclosing array if
the XML reader were asked for a number.
"""

SCRIPT = "array<struct<_id:string,_output:string>>"

NMAP_HOST = f"""
status struct<_state:string>,
address array<struct<_addr:string,_addrtype:string,_vendor:string>>,
hostnames struct<hostname:array<struct<_name:string>>>,
ports struct<port:array<struct<
    _protocol:string,_portid:string,state:struct<_state:string>,
    service:struct<_name:string,_product:string,_version:string,_servicefp:string,cpe:array<string>>,
    script:{SCRIPT}>>>,
os struct<osmatch:array<struct<_name:string,_accuracy:string>>,osfingerprint:array<struct<_fingerprint:string>>>,
hostscript struct<script:{SCRIPT}>,
trace struct<hop:array<struct<_ttl:string,_ipaddr:string,_host:string,_rtt:string>>>
"""

NMAP_RUN = "_scanner string, _args string, _start string, _startstr string, _version string"
NMAP_RUNSTATS = "finished struct<_timestr:string>, hosts struct<_up:string,_down:string,_total:string>"

NESSUS_HOST = """
_name string,
HostProperties struct<tag:array<struct<_name:string,_VALUE:string>>>,
ReportItem array<struct<
    _port:string,_protocol:string,_svc_name:string,_pluginID:string,_pluginName:string,_severity:string,
    risk_factor:string,synopsis:string,description:string,solution:string,plugin_output:string,
    cvss_base_score:string,cvss3_base_score:string,vpr_score:string,exploit_available:string,
    stig_severity:string,see_also:string,cpe:string,cve:array<string>,xref:array<string>>>
"""

VULN_ENTRIES = "array<struct<cve:string,cvss:double,severity:string,desc:string,description:string>>"
VULN_DB = f"map<string,{VULN_ENTRIES}>"
VULN_DB_LINE = "cpe string, ord bigint, cve string, cvss double, severity string, desc string"

_METRIC = "array<struct<cvssData:struct<baseScore:double>>>"
NVD_CVE = f"""struct<
    id:string,published:string,
    metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,
    descriptions:array<struct<lang:string,value:string>>,
    configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>>"""
NVD_PAGE = f"totalResults bigint, vulnerabilities array<struct<cve:{NVD_CVE}>>"

TAG_RECORD = "labels array<string>, owner string, notes string, lastIp string, lastSeen string"

# Observation tables as the readers produce them, in the order they are loaded.
_KEY = "scan_id string, host_ord struct<block:bigint,row:bigint>, ip string, load_ord bigint"
OBSERVATIONS = {
    "hosts": f"""{_KEY}, mac string, mac_vendor string, hostname string, netbios_name string, status string,
        os array<struct<name:string,accuracy:int>>, os_name string, os_accuracy int, os_fingerprint string,
        cpes array<string>, credentialed_scan boolean""",
    "ports": f"""{_KEY}, port_ord int, port int, proto string, state string, svc string, product string,
        version string, cpe string, fp string""",
    "scripts": f"{_KEY}, port int, script_id string, output string",
    "trace": f"{_KEY}, hop_ord int, ttl int, hop_ip string, hop_host string, rtt double",
    "findings": f"""{_KEY}, finding_ord int, plugin_id int, plugin_name string, severity int, severity_label string,
        risk_factor string, cvss double, cvss3 double, vpr double, cves array<string>, cpe string, synopsis string,
        description string, solution string, output string, exploit_available boolean, stig_severity string,
        refs string, xrefs array<string>, port int, proto string, svc string""",
}
