"""SQL for the registered queries, over the same tables, for an independent engine.

A graph is a chain of common table expressions from the tables to capped
neighbour rows; a walk is a recursive one, with a running sum over the
candidates for the draw.
"""

from __future__ import annotations

SEP = "chr(1)"
SEED = 7
WALKS = 2
STEPS = 4
LONG_STEPS = 80

_CUSTOMER = ("SELECT 'c'||c_custkey AS node, regexp_replace(c_mktsegment||'_'||c_nationkey, "
             "'\\s', '_', 'g') AS feat FROM customer")
_PART = ("SELECT 'p'||p_partkey AS node, regexp_replace(p_brand||'_'||p_size, "
         "'\\s', '_', 'g') AS feat FROM part")
_SUPPLIER = "SELECT 's'||s_suppkey AS node, s_nationkey::VARCHAR AS feat FROM supplier"
_SALES = ("SELECT l_linenumber AS n, 'c'||o_custkey AS c, 'p'||l_partkey AS p, 's'||l_suppkey AS s, "
          "l_orderkey AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
_USER = """SELECT node, regexp_replace(event_type, '\\s', '_', 'g') AS feat FROM (
  SELECT 'u'||user_id AS node, event_type, count(*) AS n FROM events GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, event_type) = 1"""
_KEYS = "SELECT DISTINCT 'k'||(props::JSON->>'k') AS node, (props::JSON->>'k') AS feat FROM events"

_GRAPHS = {
    "customer_part": ("SELECT c AS src, p AS dst FROM sales", _CUSTOMER, _PART),
    "supplier_part": ("SELECT s AS src, p AS dst FROM sales", _SUPPLIER, _PART),
    "user_key": ("SELECT 'u'||user_id AS src, 'k'||(props::JSON->>'k') AS dst FROM events",
                 _USER, _KEYS),
    "tripartite": ("SELECT c AS src, p AS dst FROM sales UNION ALL SELECT p, s FROM sales "
                   "UNION ALL SELECT c, s FROM sales",
                   f"{_CUSTOMER} UNION ALL {_PART} UNION ALL {_SUPPLIER}",
                   f"{_CUSTOMER} UNION ALL {_PART} UNION ALL {_SUPPLIER}"),
}


def padded(graph: str, weighted: bool = True) -> list[str]:
    pairs, one, two = _GRAPHS[graph]
    return [
        f"sales AS ({_SALES})", f"pairs AS ({pairs})", f"feat1 AS ({one})", f"feat2 AS ({two})",
        f"""padded AS (SELECT DISTINCT e.src, a.feat AS src_feat, e.dst, b.feat AS dst_feat, e.weight
          FROM (SELECT src, dst, {'count(*)' if weighted else '1'}::DOUBLE AS weight
                FROM pairs GROUP BY src, dst) e
          JOIN feat1 a ON a.node = e.src JOIN feat2 b ON b.node = e.dst)""",
    ]


def indexed(graph: str, weighted: bool = True) -> list[str]:
    return padded(graph, weighted) + [
        """node2id AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::BIGINT AS id
          FROM (SELECT src AS node FROM padded UNION SELECT dst FROM padded))""",
        """indexed AS (SELECT s.id AS src_id, d.id AS dst_id, src_feat, dst_feat, weight
          FROM padded JOIN node2id s ON s.node = src JOIN node2id d ON d.node = dst)""",
    ]


def adj(graph: str, degree: int | None = 50, directed: bool = False, weighted: bool = True) -> list[str]:
    other = "" if directed else " UNION ALL SELECT dst_id, src_id, weight, src_feat FROM indexed"
    cap = "" if degree is None else (
        f" QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, nbr) <= {degree}")
    return indexed(graph, weighted) + [f"""adj AS (SELECT * FROM (
          SELECT id, nbr, max(weight) AS weight, min(feat) AS feat FROM (
            SELECT src_id AS id, dst_id AS nbr, weight, dst_feat AS feat FROM indexed{other})
          GROUP BY id, nbr){cap})"""]


def uniform(walk_no: str, start: str, step: str) -> str:
    return (f"((('0x'||substr(md5('{SEED}|'||{walk_no}||'|'||{start}||'|'||{step}), 1, 8))::BIGINT"
            " + 0.5::DOUBLE) / 4294967296.0::DOUBLE)")


def first_hop(walks: int = WALKS, where: str = "TRUE") -> str:
    return f"""hop0 AS (SELECT walk_no, start, nbr, feat FROM (
        SELECT w.i::INTEGER AS walk_no, a.id AS start, a.nbr, a.feat,
          sum(weight) OVER (PARTITION BY w.i, a.id ORDER BY a.nbr) AS run,
          sum(weight) OVER (PARTITION BY w.i, a.id) AS total,
          {uniform('w.i', 'a.id', '0')} AS u
        FROM adj a, range({walks}) w(i) WHERE {where}) WHERE run >= u * total
        QUALIFY row_number() OVER (PARTITION BY walk_no, start ORDER BY nbr) = 1)"""


def walk(p: float = 1.0, q: float = 1.0, steps: int = STEPS, walks: int = WALKS,
         where: str = "TRUE", ends: bool = False) -> list[str]:
    """CTEs ending in walk(walk_no, start, path_text, feats_text), on a CTE named adj."""
    last = f"step = {steps}"
    if ends:
        last += " OR NOT EXISTS (SELECT 1 FROM adj WHERE id = cur)"
    return [first_hop(walks, where), f"""steps AS (
      SELECT walk_no, start, 0 AS step, start AS prev, nbr AS cur,
        start||' '||nbr AS path_text, feat AS feats_text FROM hop0
      UNION ALL
      SELECT walk_no, start, step, prev, cur, path_text, feats_text FROM (
        SELECT *, sum(b) OVER (PARTITION BY walk_no, start ORDER BY cur) AS run,
          sum(b) OVER (PARTITION BY walk_no, start) AS total FROM (
          SELECT w.walk_no, w.start, w.step + 1 AS step, w.cur AS prev, a.nbr AS cur,
            w.path_text||' '||a.nbr AS path_text, w.feats_text||' '||a.feat AS feats_text,
            {uniform('w.walk_no', 'w.start', '(w.step + 1)')} AS u,
            CASE WHEN a.nbr = w.prev THEN a.weight / {p}::DOUBLE
                 WHEN c.nbr IS NOT NULL THEN a.weight ELSE a.weight / {q}::DOUBLE END AS b
          FROM steps w JOIN adj a ON a.id = w.cur
          LEFT JOIN adj c ON c.id = w.prev AND c.nbr = a.nbr
          WHERE w.step < {steps})) x
      WHERE run >= u * total
      QUALIFY row_number() OVER (PARTITION BY walk_no, start ORDER BY cur) = 1)""",
            f"walk AS (SELECT walk_no, start, path_text, feats_text FROM steps WHERE {last})"]


# Alias tables by their definition: a light entry's bucket is filled by the first heavy
# one that has more to spare, up to itself, than lighter ones before lack; a heavy one
# keeps what is left of it once the lights up to that point are filled.
ALIAS = ["""placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nbr)::INTEGER AS place,
      count(*) OVER (PARTITION BY id) AS n, sum(weight) OVER (PARTITION BY id) AS total FROM adj)""",
    """parted AS (SELECT *, n * weight <= total AS light,
      sum(greatest(total - n * weight, 0)) OVER (PARTITION BY id ORDER BY place) AS lack,
      sum(greatest(n * weight - total, 0)) OVER (PARTITION BY id ORDER BY place) AS spare FROM placed)""",
    """tables AS (
      SELECT l.id, l.place, l.nbr, l.feat, l.weight, l.n, l.total, l.n * l.weight AS prob, coalesce(min(h.place), l.place) AS other
      FROM parted l LEFT JOIN parted h ON h.id = l.id AND NOT h.light AND h.spare > l.lack - (l.total - l.n * l.weight)
      WHERE l.light GROUP BY l.id, l.place, l.nbr, l.feat, l.weight, l.n, l.total
      UNION ALL
      SELECT h.id, h.place, h.nbr, h.feat, h.weight, h.n, h.total, least(h.total, h.total + h.spare - min(l.lack)) AS prob,
        coalesce((SELECT min(o.place) FROM parted o WHERE o.id = h.id AND NOT o.light AND o.place > h.place), h.place) AS other
      FROM parted h JOIN parted l ON l.id = h.id AND l.light AND l.lack >= h.spare WHERE NOT h.light
      GROUP BY h.id, h.place, h.nbr, h.feat, h.weight, h.n, h.total, h.spare)"""]
TRIES = 4


def number(bits: str, k: int) -> str:
    return f"((('0x'||substr({bits}, {8 * k + 1}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def taken(u: str, v: str) -> str:
    """The place that the table gives, known to all rows of a list."""
    return (f"max(CASE WHEN place = floor({u} * n)::INTEGER + 1 THEN CASE WHEN {v} * total < prob THEN place ELSE other END END) "
            "OVER (PARTITION BY walk_no, start)")


def alias_walk(p: float = 1.0, q: float = 1.0, steps: int = STEPS, walks: int = WALKS) -> list[str]:
    """CTEs ending in walk, by alias tables; biased walks propose, accept or reject, and weigh after ``TRIES`` tries."""
    high = max(1.0, 1 / q)
    name = f"'{SEED}|'||walk_no||'|'||start||'|'||"
    first = f"""hop0 AS (SELECT walk_no, start, nbr, feat FROM (SELECT *, {taken(number('bits', 0), number('bits', 1))} AS drawn
        FROM (SELECT w.i::INTEGER AS walk_no, id AS start, t.*, md5('{SEED}|'||w.i||'|'||id||'|0') AS bits FROM tables t, range({walks}) w(i)))
        WHERE place = drawn)"""
    entries = f"""SELECT w.walk_no, w.start, w.step + 1 AS step, w.prev AS before, w.cur, w.path_text, w.feats_text, t.place, t.n, t.total,
        t.prob, t.other, t.nbr, t.feat, t.weight, CASE WHEN t.nbr = w.prev THEN 1 / {p}::DOUBLE WHEN c.nbr IS NOT NULL THEN 1.0::DOUBLE ELSE 1 / {q}::DOUBLE END AS bias
        FROM steps w JOIN tables t ON t.id = w.cur LEFT JOIN adj c ON c.id = w.prev AND c.nbr = t.nbr WHERE w.step < {steps}"""
    if p == q == 1:
        chosen = f"""SELECT *, {taken(number('bits', 0), number('bits', 1))} AS drawn FROM (SELECT *, md5({name}step) AS bits FROM ({entries}))"""
    else:
        own = "OVER (PARTITION BY walk_no, start)"
        bits = ", ".join(f"sha256({name}step||'|{k}') AS bits{k}" for k in range((TRIES + 1) // 2))
        at = lambda k, i: number(f"bits{k // 2}", 3 * (k % 2) + i)
        proposed = ", ".join(f"{taken(at(k, 0), at(k, 1))} AS proposed{k}" for k in range(TRIES))
        biases = ", ".join(f"max(CASE WHEN place = proposed{k} THEN least(bias, {high}) END) {own} AS bias{k}" for k in range(TRIES))
        tries = ", ".join(f"""CASE WHEN {at(k, 2)} * area >= {high} * total THEN back
            WHEN bias{k} * total > {at(k, 2)} * area THEN proposed{k} END""" for k in range(TRIES))
        chosen = f"""SELECT *, coalesce({tries}, min(CASE WHEN run >= {number('bits0', 6)} * sum_b THEN place END) {own}) AS drawn FROM (
          SELECT *, {biases}, {high} * total + {max(0.0, 1 / p - high)} * back_weight AS area FROM (
            SELECT *, {proposed}, max(CASE WHEN nbr = before THEN place END) {own} AS back,
              coalesce(max(CASE WHEN nbr = before THEN weight END) {own}, 0) AS back_weight,
              sum(weight * bias) OVER (PARTITION BY walk_no, start ORDER BY place) AS run, sum(weight * bias) {own} AS sum_b
            FROM (SELECT *, {bits} FROM ({entries}))))"""
    return [*ALIAS, first, f"""steps AS (
      SELECT walk_no, start, 0 AS step, start AS prev, nbr AS cur, start||' '||nbr AS path_text, feat AS feats_text FROM hop0
      UNION ALL
      SELECT walk_no, start, step, cur, nbr, path_text||' '||nbr, feats_text||' '||feat FROM ({chosen}) WHERE place = drawn)""",
            f"walk AS (SELECT walk_no, start, path_text, feats_text FROM steps WHERE step = {steps})"]


def sql(ctes: list[str], select: str) -> str:
    recursive = any(c.startswith("steps AS") for c in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + f"\n{select}"


_WALK = "SELECT walk_no, start, path_text, feats_text FROM walk"
_SPACE = r"[ \t\n\x0B\f\r]"
_WORD = r"[^ \t\n\x0B\f\r]"


def trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def first_token(value: str) -> str:
    return f"regexp_extract({trimmed(value)}, '^({_WORD}*)', 1)"


def last_token(value: str) -> str:
    return f"regexp_extract({trimmed(value)}, '({_WORD}*)$', 1)"


def two_tokens(value: str) -> str:
    return f"regexp_matches({value}, '{_WORD}{_SPACE}+{_WORD}')"


_EDGE_LINES = [f"sales AS ({_SALES})", """lines AS (SELECT CASE n
    WHEN 1 THEN c||' '||p WHEN 2 THEN '  '||c||chr(9)||p||' ' WHEN 3 THEN c||' x  y '||p
    WHEN 4 THEN c||' ' WHEN 5 THEN ' '||chr(9)||' ' WHEN 6 THEN ''
    ELSE c||'   '||p END AS value FROM sales)"""]

_FEATURE_LINES = ["""lines AS (SELECT concat_ws(' ', 'p'||p_partkey, p_name, p_type,
    CASE WHEN p_size > 25 THEN p_brand END) AS value FROM part)"""]

# What the shapes of padded lines must give, stated per shape rather than parsed.
_PADDED = """SELECT 's'||l_suppkey AS src,
    CASE l_linenumber WHEN 3 THEN 's'||l_suppkey WHEN 4 THEN 's'||l_suppkey
      ELSE l_returnflag END AS src_feat,
    'p'||l_partkey AS dst,
    CASE l_linenumber WHEN 3 THEN 'p'||l_partkey ELSE l_linestatus END AS dst_feat,
    CASE l_linenumber WHEN 1 THEN trunc(l_quantity) ELSE 1 END::DOUBLE AS weight
    FROM lineitem WHERE l_linenumber NOT IN (5, 6)
      AND (l_linenumber <> 1 OR trunc(l_quantity) > 0)"""

_DOC_LINES = ["""doc_lines AS (SELECT doc_id, (unnest(range(1, len(parts) + 1)) - 1)::INTEGER AS pos,
    unnest(parts) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""]


def _line_counts() -> str:
    return sql(_EDGE_LINES, f"SELECT value, count(*) AS n FROM lines WHERE {two_tokens('value')} "
               "GROUP BY value")


_NAMED = "FROM walk JOIN node2id ON id = start"
_NODE2FEAT = "(SELECT DISTINCT src AS fnode, src_feat AS feat FROM padded)"
_CP_WALK = adj("customer_part") + walk()
_FILE_ADJ = adj("customer_part", weighted=False)
_FILE_WALK = _FILE_ADJ + alias_walk()
_UK_WALK = adj("user_key") + walk()
_UK_PQ_WALK = adj("user_key") + walk(0.5, 2.0)


def _files(name: str, node: str, node2feat: str) -> str:
    """The lines of the three walk files, vertices called ``name``."""
    return f"""SELECT 'ids' AS sink, {name}||{SEP}||start||{SEP}||path_text AS value {_NAMED}
        UNION ALL SELECT 'feats', {name}||{SEP}||start||{SEP}||feats_text {_NAMED}
        UNION ALL SELECT 'feats2', {name}||{SEP}||feat||{SEP}||feats_text {_NAMED} JOIN {node2feat} f ON fnode = {node}"""


_FEATS_MET = "(SELECT DISTINCT unnest(string_split(feats_text, ' ')) AS word FROM walk)"

ORACLES: dict[str, str] = {
    "read_edges": sql(_EDGE_LINES, f"""SELECT {first_token('value')} AS src,
        {last_token('value')} AS dst, 1.0::DOUBLE AS weight FROM lines WHERE {two_tokens('value')}"""),
    "read_features": sql(_FEATURE_LINES, f"""SELECT {first_token('value')} AS node,
        {last_token('value')} AS feat FROM lines WHERE {two_tokens('value')}"""),
    "read_padded": _PADDED,
    "read_node2feat": f"SELECT node, feat FROM ({_CUSTOMER})",
    "read_corpus": sql(_DOC_LINES, f"""SELECT len(string_split(words, ' '))::INTEGER AS n_tokens,
        words AS tokens_text FROM (SELECT regexp_replace({trimmed('value')}, '{_SPACE}+', ' ', 'g')
        AS words FROM doc_lines) WHERE words <> ''"""),
    "read_feat_corpus": sql([f"sales AS ({_SALES})"], "SELECT p||' '||s AS tokens_text FROM sales"),
    "read_indexed": """SELECT l_suppkey AS src_id, l_partkey AS dst_id, l_returnflag AS src_feat,
        l_linestatus AS dst_feat, l_linenumber::DOUBLE AS weight FROM lineitem
        WHERE l_returnflag <> 'A'""",
    "drop_malformed": _line_counts(),
    # What the shapes of dropped lines are, stated per shape.
    "rejected_lines": f"""SELECT kind, reason, value, count(*) AS n FROM (
        SELECT 'edges' AS kind, CASE n WHEN 4 THEN 'one token' ELSE 'blank' END AS reason,
          CASE n WHEN 4 THEN c||' ' WHEN 5 THEN ' '||chr(9)||' ' ELSE '' END AS value FROM ({_SALES}) WHERE n IN (4, 5, 6)
        UNION ALL SELECT 'padded', CASE l_linenumber WHEN 5 THEN 'no name' ELSE 'weight not above 0' END,
          CASE l_linenumber WHEN 5 THEN {SEP}||'s'||l_suppkey||' p'||l_partkey||{SEP}||l_linestatus
            ELSE 's'||l_suppkey||{SEP}||'x'||{SEP}||l_returnflag||' p'||l_partkey||{SEP}||l_linestatus||
              CASE l_linenumber WHEN 6 THEN ' 0' ELSE ' '||trunc(l_quantity)::INTEGER END END
        FROM lineitem WHERE l_linenumber IN (5, 6) OR (l_linenumber = 1 AND trunc(l_quantity) <= 0)) GROUP BY ALL""",
    "edge_weight": sql(_DOC_LINES, f"""SELECT doc_id, pos, coalesce(try_cast(
        {last_token('value')} AS DOUBLE), 1.0)::DOUBLE AS weight FROM doc_lines"""),
    "pad_edges": sql(padded("customer_part", False), f"""SELECT src||{SEP}||src_feat||' '||
        dst||{SEP}||dst_feat AS value FROM padded"""),
    "pad_edges_multi": """SELECT DISTINCT e.src, a.feat AS src_feat, e.dst, b.feat AS dst_feat,
        1.0::DOUBLE AS weight
        FROM (SELECT DISTINCT 's'||l_suppkey AS src, 'p'||l_partkey AS dst FROM lineitem) e
        JOIN (SELECT DISTINCT 's'||l_suppkey AS node, l_returnflag AS feat FROM lineitem
              WHERE l_linestatus = 'O') a ON a.node = e.src
        JOIN (SELECT DISTINCT 'p'||l_partkey AS node, l_linestatus AS feat FROM lineitem
              WHERE l_returnflag = 'R') b ON b.node = e.dst""",
    "node2feat": sql(padded("user_key"), """SELECT src AS node, src_feat AS feat FROM padded
        UNION SELECT dst, dst_feat FROM padded"""),
    "node2feat_src": sql(padded("tripartite"),
                         "SELECT DISTINCT src AS node, src_feat AS feat FROM padded"),
    "node2id": sql(indexed("tripartite"), "SELECT node, id FROM node2id"),
    "node2id_text": sql(indexed("supplier_part"), "SELECT node, id FROM node2id"),
    "index_edges": sql(indexed("supplier_part"), "SELECT * FROM indexed"),
    "half_indexed_text": sql(indexed("supplier_part"), f"""SELECT dst||' '||{SEP}||' '||id||' '||
        src_feat||' '||dst_feat AS value FROM padded JOIN node2id ON node = src"""),
    "neighbour_edges": sql(adj("customer_part", None), "SELECT id, nbr, weight, feat FROM adj"),
    "adjacency": sql(adj("customer_part"), """SELECT id, count(*)::INTEGER AS n,
        string_agg(nbr::VARCHAR, ' ' ORDER BY nbr) AS nbrs, string_agg(feat, ' ' ORDER BY nbr) AS feats
        FROM adj GROUP BY id"""),
    "adjacency_directed": sql(adj("tripartite", 50, True, False),
                              "SELECT id, nbr, weight, feat FROM adj"),
    "degree_cap": sql(adj("supplier_part"), "SELECT id, nbr, weight, feat FROM adj"),
    "adj_edges": sql(adj("user_key", 50), "SELECT id, nbr, weight, feat FROM adj"),
    "triplets": sql(adj("user_key", 50) + [
        "lists AS (SELECT id, string_agg(nbr::VARCHAR, ' ' ORDER BY nbr) AS nbrs FROM adj GROUP BY id)"],
        """SELECT a.id AS src_id, a.nbr AS dst_id, a.weight, a.feat AS dst_feat,
        s.nbrs AS src_nbrs, d.nbrs AS dst_nbrs
        FROM adj a JOIN lists s ON s.id = a.id JOIN lists d ON d.id = a.nbr"""),
    "transition1": sql(adj("customer_part"), """SELECT id, nbr,
        weight / sum(weight) OVER (PARTITION BY id) AS prob FROM adj"""),
    "transition2": sql(adj("tripartite", 50), """SELECT prev, cur, count(*)::INTEGER AS n,
        string_agg(nbr||':'||floor(prob * 1099511627776)::BIGINT, ' ' ORDER BY nbr) AS probs FROM (SELECT prev, cur, nbr,
        b / sum(b) OVER (PARTITION BY prev, cur) AS prob FROM (
        SELECT e.id AS prev, e.nbr AS cur, a.nbr,
          CASE WHEN a.nbr = e.id THEN a.weight / 0.25::DOUBLE WHEN c.nbr IS NOT NULL THEN a.weight
               ELSE a.weight / 4.0::DOUBLE END AS b
        FROM adj e JOIN adj a ON a.id = e.nbr LEFT JOIN adj c ON c.id = e.id AND c.nbr = a.nbr)) GROUP BY prev, cur"""),
    "alias_tables": sql(adj("customer_part") + ALIAS, "SELECT id, place, nbr, prob, other, total FROM tables"),
    "alias_draw": sql(adj("customer_part") + ALIAS, f"""SELECT t.id, o.nbr FROM (
        SELECT id, CASE WHEN {number('bits', 1)} * total < prob THEN place ELSE other END AS drawn FROM (
          SELECT *, md5('{SEED}|3|'||id||'|0') AS bits FROM tables) WHERE place = floor({number('bits', 0)} * n)::INTEGER + 1) t
        JOIN tables o ON o.id = t.id AND o.place = t.drawn"""),
    "weighted_draw": sql(adj("customer_part"), f"""SELECT id, nbr, weight, feat FROM (
        SELECT *, sum(weight) OVER (PARTITION BY id ORDER BY nbr) AS run,
          sum(weight) OVER (PARTITION BY id) AS total, {uniform("'3'", 'id', '0')} AS u FROM adj)
        WHERE run >= u * total QUALIFY row_number() OVER (PARTITION BY id ORDER BY nbr) = 1"""),
    "walk_start": sql(adj("customer_part") + walk(steps=0), _WALK),
    "walk_step": sql(adj("customer_part") + walk(2.0, 0.5, 1), _WALK),
    "random_walk": sql(_CP_WALK, _WALK),
    "random_walk_pq": sql(adj("customer_part") + walk(0.25, 4.0), _WALK),
    "random_walk_long": sql(adj("customer_part") + walk(steps=LONG_STEPS, walks=1), _WALK),
    "random_walk_pq_long": sql(adj("customer_part") + walk(0.25, 4.0, LONG_STEPS, 1), _WALK),
    "random_walk_alias": sql(adj("customer_part") + alias_walk(steps=LONG_STEPS, walks=1), _WALK),
    "random_walk_alias_tri": sql(adj("tripartite") + alias_walk(0.25, 0.5, 20, 1), _WALK),
    "random_walk_tri": sql(adj("tripartite") + walk(2.0, 0.5), _WALK),
    "random_walk_hubs": sql(adj("supplier_part") + walk(4.0, 1.0), _WALK),
    "random_walk_directed": sql(adj("tripartite", directed=True) + walk(ends=True), _WALK),
    # Starts at customers together with starts at parts are all starts.
    "multi_walk": sql(adj("customer_part") + walk(steps=2, walks=3), _WALK),
    "feature_walk": sql(_UK_PQ_WALK, "SELECT walk_no, start, feats_text FROM walk"),
    "hop_tag": sql(adj("tripartite") + walk() + ["""hops AS (SELECT walk_no, start,
        unnest(range(1, len(parts)))::INTEGER AS hop, unnest(parts[2:])::BIGINT AS node
        FROM (SELECT walk_no, start, string_split(path_text, ' ') AS parts FROM walk))"""],
        """SELECT walk_no, start, hop, node, CASE WHEN node = start THEN 0
        WHEN a.nbr IS NOT NULL THEN 1 ELSE 2 END::INTEGER AS tag
        FROM hops LEFT JOIN adj a ON a.id = start AND a.nbr = node"""),
    "walks_named": sql(_CP_WALK, f"SELECT walk_no, node, start, path_text {_NAMED}"),
    "walks_with_feat": sql(_CP_WALK, f"""SELECT walk_no, node, start, feat, feats_text {_NAMED}
        JOIN {_NODE2FEAT} f ON fnode = node"""),
    "walk_text": sql(_CP_WALK, f"SELECT node||{SEP}||start||{SEP}||path_text AS value {_NAMED}"),
    "feat_walk_text": sql(_CP_WALK,
                          f"SELECT node||{SEP}||start||{SEP}||feats_text AS value {_NAMED}"),
    "feat_walk2_text": sql(_CP_WALK, f"""SELECT node||{SEP}||feat||{SEP}||feats_text AS value
        {_NAMED} JOIN {_NODE2FEAT} f ON fnode = node"""),
    "id_corpus": sql(_CP_WALK, """SELECT token, count(*) AS n FROM (
        SELECT unnest(string_split(path_text, ' ')) AS token FROM walk) GROUP BY token"""),
    "feat_corpus": sql(_UK_PQ_WALK, "SELECT feats_text AS tokens_text FROM walk"),
    "embed_vocab": sql(_CP_WALK, f"SELECT word, 128 AS dim, TRUE AS sound FROM {_FEATS_MET}"),
    "model_reload": sql(_UK_WALK, f"SELECT word, 128 AS dim, TRUE AS sound FROM {_FEATS_MET}"),
    "node_vectors": sql(indexed("user_key"), "SELECT node, id, 128 AS dim, TRUE AS sound FROM node2id"),
    "feat_vectors": sql(_UK_WALK, f"""SELECT node, feat, 128 AS dim, TRUE AS sound FROM (
        SELECT src AS node, src_feat AS feat FROM padded
        UNION SELECT dst, dst_feat FROM padded) JOIN {_FEATS_MET} ON word = feat"""),
    "run_padding": sql(padded("customer_part", False), f"""SELECT src||{SEP}||src_feat||' '||
        dst||{SEP}||dst_feat AS value FROM padded"""),
    "run_random_walk": sql(_FILE_ADJ + alias_walk(steps=LONG_STEPS), _files("node", "node", _NODE2FEAT)),
    "run_one_write": sql(_FILE_WALK, _files("node", "node", _NODE2FEAT)),
    "run_from_starts": sql(_FILE_ADJ + alias_walk(steps=LONG_STEPS, walks=1),
                           f"SELECT * FROM ({_files('node', 'node', _NODE2FEAT)}) WHERE split_part(value, {SEP}, 1) LIKE 'c%'"),
    "run_indexed": sql(_FILE_WALK, _files("CASE WHEN start % 2 = 0 THEN node ELSE start::VARCHAR END", "node", _NODE2FEAT)),
    "run_half_indexed": sql(indexed("customer_part", weighted=False), f"""SELECT dst||' '||{SEP}||' '||id||' '||
        src_feat||' '||dst_feat AS value FROM padded JOIN node2id ON node = src"""),
    "walks_from_lists": sql(_CP_WALK, _WALK),
    "run_full_features": sql(_FILE_WALK, f"""SELECT fnode AS node, feat, 128 AS dim, TRUE AS sound
        FROM {_NODE2FEAT} JOIN {_FEATS_MET} ON word = feat"""),
    "run_embedding": sql(_FILE_WALK, f"""SELECT fnode AS node, feat, 128 AS dim, TRUE AS sound
        FROM {_NODE2FEAT} JOIN {_FEATS_MET} ON word = feat"""),
    "run_full": sql(indexed("customer_part"), "SELECT node, 128 AS dim, TRUE AS sound FROM node2id"),
}
