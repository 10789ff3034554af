"""Vocabularies, key tables, scores, line patterns and message texts.

Everything in this file is data that decides results, so it is kept in one
place and spelled out as it is.  The logic that uses it lives elsewhere.

Patterns are Java regular expressions.  The character classes are written out
because Java's ``\\w \\d \\s \\b . $`` do not mean the same as in the Unicode
rules the formats are defined with.
"""

# --- character classes -------------------------------------------------------

# every code point counted as white space, in code point order
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_BLANK_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
S = f"[{_BLANK_SET}]"
NS = f"[^{_BLANK_SET}]"
W = r"[A-Za-z0-9_\p{L}\p{N}]"
ALNUM = r"[A-Za-z0-9\p{L}\p{N}]"
D = r"\p{Nd}"
NOT_AFTER_WORD = f"(?<!{W})"
NOT_BEFORE_WORD = f"(?!{W})"

# --- formats and detection rules ---------------------------------------------

JSON, CEF, LEEF, XML, SYSLOG, UNKNOWN = "JSON", "CEF", "LEEF", "XML", "SYSLOG", "UNKNOWN"
KNOWN_FORMATS = [JSON, CEF, LEEF, SYSLOG, XML]

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
TAG_NAME = rf"[A-Za-z_][A-Za-z0-9_.\-\p{{L}}\p{{N}}]*"
_CLOCK = rf"{D}{{2}}:{D}{{2}}:{D}{{2}}"
_STAMP_3164 = rf"[A-Z][a-z]{{2}}{S}+{D}{{1,2}}{S}{_CLOCK}"
_ISO_DAY = rf"{D}{{4}}-{D}{{2}}-{D}{{2}}"
_ZONE = rf"(?:Z|[+-]{D}{{2}}:?{D}{{2}})?"

CEF_START = rf"\ACEF:{D}+\|"
LEEF_BAR_START = rf"\ALEEF:[12]\.{D}+\|"
LEEF_3_START = rf"\ALEEF:3\.{D}+{S}"
CEF_INSIDE = rf"{NOT_AFTER_WORD}CEF:{D}+\|"
LEEF_INSIDE = rf"{NOT_AFTER_WORD}LEEF:[123]\.{D}+[| ]"
XML_ROOT = rf"\A<({TAG_NAME})"
# two tags, each of one character or more; text up to a ``>`` without a tag is passed over once, so time grows with the line
_NO_TAG = r"(?:[^<>]*+<?+>)*+"
TWO_TAGS = rf"\A{_NO_TAG}[^<>]*+<[^>]++>{_NO_TAG}[^<>]*+<[^>]++>"
RFC_5424 = rf"\A(?:<{D}{{1,3}}>{D}{S})?{_ISO_DAY}T{_CLOCK}(?:\.{D}+)?{_ZONE}{S}+{NS}+{S}+{NS}+"
RFC_3164 = (
    rf"\A(?:<{D}{{1,3}}>)?(?:{_STAMP_3164}|{_ISO_DAY}[T ]{_CLOCK}(?:[.,]{D}+)?)"
    rf"{S}+{NS}+{S}+[^:\[{_BLANK_SET}]+(?:\[{D}+\])?:"
)
CEF_BAD_VERSION = rf"\ACEF:[^|{D}]"
MONTH_START = rf"\A(?:<{D}{{1,3}}>)?(?:{MONTHS}){S}+{D}{{1,2}}{S}{_CLOCK}{S}"

# rule number -> (format, confidence, reason); the number is the order of the test
RULES = [
    (UNKNOWN, 0.0, "empty input"),
    (JSON, 0.98, "valid JSON object parsed"),
    (JSON, 0.98, "valid JSON array parsed"),
    (CEF, 0.98, "CEF header detected: 'CEF:<version>|' prefix"),
    (LEEF, 0.98, "LEEF header detected: 'LEEF:1.x|' or 'LEEF:2.x|' prefix"),
    (LEEF, 0.98, "LEEF header detected: 'LEEF:3.x ' carriage-return separated header"),
    (XML, 0.95, "well-formed XML document detected"),
    (CEF, 0.85, "CEF payload detected inside syslog-style wrapper"),
    (LEEF, 0.85, "LEEF payload detected inside syslog-style wrapper"),
    (SYSLOG, 0.92, "RFC 5424 syslog pattern (PRI/version + ISO timestamp + host)"),
    (SYSLOG, 0.90, "RFC 3164 syslog pattern (timestamp + host + process[pid]:)"),
    (CEF, 0.4, "'CEF:' prefix present but version malformed — treated as heuristic CEF match"),
    (SYSLOG, 0.55, "month-name + timestamp + host opening — heuristic syslog match"),
    (UNKNOWN, 0.0, "no known format signature matched"),
]
DETECT_METHOD = "deterministic signatures (prototype heuristics, not ML)"

# --- canonical fields --------------------------------------------------------

SRC_IP, SRC_PORT = "network.source_ip", "network.source_port"
DST_IP, DST_PORT = "network.destination_ip", "network.destination_port"

# how a value of a canonical field is normalised; every other field is only trimmed
IP_FIELDS = [SRC_IP, DST_IP]
PORT_FIELDS = [SRC_PORT, DST_PORT]
UPPER_FIELDS = ["network_protocol"]
LOWER_FIELDS = ["action", "severity"]

IPV4 = rf"{D}{{1,3}}(?:\.{D}{{1,3}}){{3}}"
# for texts of the shape above, whose parts have three digits at most
OCTET_OVER_255 = r"(?:\A|\.)(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])(?:\.|\z)"
# digits with single underscores between them; repeated groups would recurse on long texts, so doubled and
# trailing underscores are a second pattern
INTEGER = rf"\A[+-]?{D}[_\p{{Nd}}]*+\z"
NOT_INTEGER = r"__|_\z"
# digits beyond which a text is not read as a number
MAX_DIGITS = 4300
MAX_PORT = 65535

# --- key tables --------------------------------------------------------------

# JSON: canonical field -> candidate keys in order of preference
JSON_KEYS = {
    SRC_IP: ["src_ip", "source_ip", "src", "sourceAddress", "client_ip", "srcip"],
    SRC_PORT: ["src_port", "source_port", "sport", "sourcePort", "client_port"],
    DST_IP: ["dst_ip", "dest_ip", "destination_ip", "dst", "dest", "destinationAddress", "target_ip"],
    DST_PORT: ["dst_port", "dest_port", "destination_port", "dport", "destinationPort"],
    "network_protocol": ["proto", "protocol", "network_protocol", "transport"],
    "action": ["action", "act", "verdict", "decision", "disposition"],
    "policy_id": ["policy_id", "policy", "rule_id", "rule", "policyid"],
    "severity": ["severity", "sev", "level", "priority"],
    "signature_id": ["signature_id", "sig_id", "signature", "attack_id"],
    "user": ["user", "username", "user_name", "usr", "account"],
    "host": ["host", "hostname", "device"],
    "message": ["message", "msg", "log", "description", "reason"],
    "timestamp": ["timestamp", "time", "event_time", "@timestamp", "datetime", "date"],
    "vendor": ["vendor"],
    "product": ["product", "device_product", "app"],
}

# other formats: key or tag -> canonical field
CEF_KEYS = {
    "src": SRC_IP, "sourceAddress": SRC_IP, "spt": SRC_PORT, "sourcePort": SRC_PORT,
    "dst": DST_IP, "destinationAddress": DST_IP, "dpt": DST_PORT, "destinationPort": DST_PORT,
    "proto": "network_protocol", "act": "action", "cs1": "policy_id", "policyid": "policy_id",
    "duser": "user", "suser": "user", "dvc": "host", "shost": "host",
}
LEEF_KEYS = {
    "src": SRC_IP, "srcPort": SRC_PORT, "dst": DST_IP, "dstPort": DST_PORT,
    "proto": "network_protocol", "cat": "category", "sev": "severity",
    "usrName": "user", "username": "user", "identHostName": "host", "policy": "policy_id",
}
SYSLOG_KEYS = {
    "src": SRC_IP, "srcip": SRC_IP, "spt": SRC_PORT, "dst": DST_IP, "dstip": DST_IP, "dpt": DST_PORT,
    "proto": "network_protocol", "action": "action", "policy": "policy_id", "user": "user",
}
XML_KEYS = {
    "src": SRC_IP, "source_ip": SRC_IP, "dst": DST_IP, "dest": DST_IP, "destination_ip": DST_IP,
    "src_port": SRC_PORT, "spt": SRC_PORT, "dst_port": DST_PORT, "dpt": DST_PORT,
    "proto": "network_protocol", "protocol": "network_protocol", "action": "action", "verdict": "action",
    "policy": "policy_id", "policy_id": "policy_id", "user": "user", "usrName": "user",
    "host": "host", "hostname": "host", "message": "message", "msg": "message",
    "timestamp": "timestamp", "time": "timestamp", "severity": "severity",
    "vendor": "vendor", "product": "product", "signature": "signature_id",
}

# --- line layouts ------------------------------------------------------------

CEF_PAYLOAD = rf"(?s)\A(?:<{D}+>)?{D}?{S}*(?:{_STAMP_3164}{S}+{NS}+{S}+)?(CEF:{D}+\|.*)\z"
# a value ends before the first blank of the run that comes before the next key
CEF_PAIR = rf"{NOT_AFTER_WORD}{W}++=[^\n]*?(?=(?<!{S}){S}++{W}++=|\n?\z)"
LEEF_HEADER = rf"\ALEEF:{D}+\.{D}+\|[^|]*\|[^|]*\|"
SYSLOG_LINE = (
    rf"(?s)\A(?:<({D}{{1,3}})>)?({_STAMP_3164}|{_ISO_DAY}T{_CLOCK}(?:\.{D}+)?{_ZONE})"
    rf"{S}+({NS}+){S}+([^:\[{_BLANK_SET}]+)(?:\[{D}+\])?:{S}?(.*)\z"
)
SYSLOG_PAIR = rf"{NOT_AFTER_WORD}{W}++={NS}+"
XML_LEAF = rf"<({TAG_NAME})(?:{S}[^>]*)?>[^<]*</\1>"
# a ``<`` before another one without ``>`` between them; an end tag without its ``>``
OPEN_TWICE = r"<[^<>]*+<"
XML_END_TAG = rf"\A</({TAG_NAME})\z"
PRI_SEVERITY = [
    "emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug",
]

PARSE_ERRORS = {
    CEF: "CEF header not parseable",
    LEEF: "LEEF header not parseable",
    SYSLOG: "Syslog pattern not parseable",
    XML: "not a well-formed XML document",
}
LEEF_INCOMPLETE = "LEEF header incomplete"
SOURCE_PREFIX = {
    CEF: "CEF extension:", LEEF: "LEEF extension:", SYSLOG: "syslog message:", XML: "XML:<",
}
CEF_SIGNATURE_SOURCE = "CEF header:Signature ID"
CEF_SEVERITY_SOURCE = "CEF header:severity"
LEEF_EVENT_SOURCE = "LEEF header:EventID"
SYSLOG_HOST_SOURCE = "syslog header:hostname"
SYSLOG_TIME_SOURCE = "syslog header:timestamp"
SYSLOG_PRI_SOURCE = ("syslog PRI ", " (facility*8+severity)")  # around the PRI number
TOKEN_SOURCE = ("token[", "]")  # around the position

BLANK_REASON = "raw_event must be a non-empty string"

# --- unknown lines -----------------------------------------------------------

TOKEN_TYPES = [  # type -> pattern of the whole token, first match wins
    ("ipv4", IPV4),
    ("protocol", "(?iu)(?:TCP|UDP|ICMP|GRE|SCTP|ESP|AH)"),
    ("port", rf"{D}{{1,5}}"),
    ("action",
     "(?iu)(?:BLK|BLOCK|DENY|DROP|REJ|REJECT|ALLOW|ACCEPT|PERMIT|PASS|"
     "ALERT|MONITOR|RESET|FORWARD|QUAR|QUARANTINE)"),
    ("policy_id", rf"(?iu)(?:P|POL|POLICY)[-_]?{D}+"),
    ("session_id", rf"(?iu)(?:S|SES|SESSION)[-_]?{D}+"),
]
IDENTIFIER = "identifier"
LEADING_NAME = r"[A-Za-z][-A-Za-z0-9_\p{L}\p{N}]*+"
ALPHA_TOKEN = r"\p{L}+"
ALNUM_TOKEN = rf"[A-Za-z]+{D}+"
ANY_PORT = rf"{NOT_AFTER_WORD}{D}{{1,5}}{NOT_BEFORE_WORD}"

# (canonical field, token position, token type, confidence), in order of the records
POSITIONS = [
    ("source.vendor", 0, "name", 0.90),
    ("source.product", 0, "name", 0.90),
    ("network_protocol", 2, "protocol", 0.96),
    (SRC_IP, 3, "ipv4", 0.94),
    (SRC_PORT, 4, "port", 0.88),
    (DST_IP, 5, "ipv4", 0.94),
    (DST_PORT, 6, "port", 0.88),
    ("action", 1, "action", 0.92),
    ("policy_id", 7, "policy_id", 0.90),
]
ONBOARD_METHOD = "prototype heuristic onboarding (deterministic, not ML)"
ONBOARD_PARSER = "unknown-onboarding"
ONBOARD_STEP = "deterministic heuristic structure/semantic discovery"
ONBOARD_DETAIL = (
    "Unknown format: deterministic heuristics proposed a semantic mapping. "
    "No ML involved. An operator would review and register this mapping "
    "before production use."
)

# texts of the two stages, around the numbers of tokens and addresses
FINGERPRINT_STAGE = ("FINGERPRINT", "pipe-delimited structure with ", " tokens; ", " IPv4 address(es) present")
STRUCTURE_STAGE = ("STRUCTURE DISCOVERY", "delimiter='|', ", " tokens typed")

# --- provenance --------------------------------------------------------------

# methods that reports name in columns of their own; any other is counted as well
METHODS = ["extracted", "heuristic", "derived"]
NO_METHOD = "unknown"

# --- integrity ---------------------------------------------------------------

DIGEST_LENGTH = 64
DIGEST_REASON = "{columns} must be a 64-char sha256 hex"

# --- validation --------------------------------------------------------------

PROTOCOLS = ["TCP", "UDP", "ICMP", "GRE", "SCTP", "ESP", "AH", "TLS", "HTTP", "HTTPS"]
ACTIONS = [
    "allow", "accept", "permit", "pass", "deny", "drop", "block", "reject",
    "alert", "reset", "monitor", "forward", "quarantine", "blk",
]
CHECKS_RUN = 9
FAIL_CHECKS = ["ip_format", "ip_octets", "port_range", "structure"]
ISSUE_TEXTS = {
    "value_absent": "not derivable from raw event",
    "ip_malformed": "malformed IPv4: ",
    "ip_octets": "octet > 255 in ",
    "ip_valid": "valid IPv4 ",
    "port_invalid": "invalid port: ",
    "port_valid": "valid port ",
    "word_absent": "not derivable",
    "protocol_unusual": "unusual protocol value ",
    "protocol_known": "recognized protocol ",
    "action_unusual": "unrecognized action ",
    "action_known": "recognized action ",
    "verbatim": " (kept verbatim)",
    "no_records": "no provenance records — nothing was derivable",
    "records": " provenance records present",
    "no_fields": "no canonical fields derived",
    "header_whole": " header fields present",
    "header_incomplete": " header incomplete",
}
