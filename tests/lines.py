"""Lines of our own, written from the public descriptions of the formats."""

UNKNOWN = "GATE-2|DROP|UDP|172.16.40.7|5353|172.16.40.9|161|P204"
ODD_PORTS = "GATE-5|PASS|TCP|172.16.8.1|65536|172.16.8.2|123456|P9"
BAD_OCTET = "GATE-2|DROP|UDP|172.16.999.7|5353|172.16.40.9|161|P204"
CEF = (
    "CEF:1|Larkfield|Weir|9.0|771|Login refused thrice|4|src=198.18.0.14 spt=40022 dst=198.18.7.3 dpt=3389 "
    "proto=UDP act=Deny cs1=R-88 cs1Label=RuleName"
)
WRAPPED_CEF = "Nov 23 04:05:06 sluice7 CEF:0|Fenland|Dyke|3|18|Heartbeat|2|src=198.18.1.1"
LEEF = "LEEF:1.0|Quayside|Breakwater|7.7|EV-31|src=198.18.0.14\tdst=198.18.7.3\tproto=GRE\tusrName=m.reed\tsev=8"
SYSLOG = (
    "<38>Nov 23 04:05:06 sluice7 floodwatch: action=RESET src=198.18.0.14 spt=40022 dst=198.18.7.3 dpt=3389 "
    "proto=UDP policy=R-88"
)
JSON = (
    '{"timestamp":"2025-11-23T04:05:06+01:00","vendor":"Peatworks","product":"Bogwatch","src_ip":"198.18.0.14",'
    '"src_port":40022,"dst_ip":"198.18.7.3","dst_port":3389,"proto":"UDP","action":"Deny","policy_id":"R-88",'
    '"severity":"Low","message":"Refused for the third time"}'
)
XML = "<Notice><src>198.18.0.14</src><dst>198.18.7.3</dst></Notice>"
