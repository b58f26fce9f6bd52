"""Table layouts of graph collections."""

NODES = "graph_id BIGINT, role STRING, node STRING, label STRING, deg INT, is_motif INT, motif_id INT"
EDGES = "graph_id BIGINT, src STRING, dst STRING"  # src < dst, distinct, no loops
SUBS = "graph_id BIGINT, k INT, nodes ARRAY<STRING>"  # nodes ascending
BUCKETS = "bucket STRING, r_pos BIGINT, r_neg BIGINT, score DOUBLE"
MERGE = "graph_id BIGINT, level INT, parent STRING, child STRING"
