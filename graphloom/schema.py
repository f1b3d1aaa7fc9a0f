"""Node and edge types, relation sets, column layouts."""

NODE_TYPES = ("structure", "program", "report", "design", "data", "memory", "decision", "config", "area", "session", "symbol", "project")
EDGE_TYPES = ("imports", "references", "belongs_to", "mentions", "touches", "defines", "calls")
KNOWLEDGE = ("imports", "references")
IMPACT = ("imports", "references", "mentions")
REGISTRY = ("imports", "references", "calls")
DOCUMENT_TYPES = ("structure", "report", "design", "decision", "memory")

#: ``extra`` holds whatever else a node carries.
NODE_SCHEMA = "id string, type string, label string, description string, path string, size bigint, date string, broken_refs array<string>, external_refs array<string>, extra map<string,string>"
#: ``ord`` is the order of insertion; of a stored graph it is null and the order is (source, target, type).
EDGE_SCHEMA = "source string, target string, type string, ord bigint, meta map<string,string>"
EDGE_ORDER = ("ord", "source", "target", "type")
