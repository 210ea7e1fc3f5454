"""Schemas of the tables that pass between stages. They are declared, never inferred."""

FILES = "path string, name string, dir string, size long, ord int"
SNAPSHOTS = "path string, source string, content_hash string, bytes long, status string, reason string"
UNITS = "path string, unit_idx int, name string, start_line int, end_line int, byte_start int, byte_end int, owner_headers array<struct<start_line:int,end_line:int>>, partial boolean"
COMMENTS = "path string, start_line int, end_line int"
INSPECTED = "path string, kind string, unit_idx int, name string, start_line int, end_line int, byte_start int, byte_end int, owner_headers array<struct<start_line:int,end_line:int>>, partial boolean, mode string"
ISSUES = "kind string, path string"
EDGES = "importer string, importee string"
REQUESTS = "req_id string, state string, questions array<struct<qid:string,instructions:string>>"
ANSWERS = "key string, schema int, created_at timestamp, answers map<string,double>, bytes long"
EXCERPT = "struct<start_line:int,end_line:int,source:string>"
LEAD = "struct<name:string,start_line:int,end_line:int,score:double>"
CALL_LEAD = "struct<caller:string,name:string,start_line:int,end_line:int>"
EVIDENCE = f"path string, score double, roles array<string>, priority int, leads array<{LEAD}>, call_leads array<{CALL_LEAD}>, excerpts array<{EXCERPT}>, source_omitted boolean"
