"""SQL twins of the queries that SQL can express.

The twins of iterated operators are written out round by round, level by level.
"""


def _clusters(rounds: int = 3, centroids: int = 16) -> str:
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
parts AS (SELECT r, unnest(v) AS x, unnest(range(64)) AS d FROM kept),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), vec_id, v) - 1)::INT AS k, v AS c FROM kept
  QUALIFY k < {centroids})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, arg_min(k, (distance, k)) AS k, min(distance)::BIGINT AS distance
  FROM (SELECT r, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM kept, c{i})
  GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS c
  FROM (SELECT k, d, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{i} JOIN parts USING (r) GROUP BY k, d) GROUP BY k),
c{i + 1} AS (SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m USING (k))""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, k AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (k)
"""


def _field(name: str, value: str | None = None) -> str:
    value = value or f"{name}::VARCHAR"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({value})::VARCHAR || ':' || {value} END"


def _merkle(levels: int = 5) -> str:
    """``levels``: enough for trees of 16 ** levels leaves."""
    fields = ["doc_id", "source", "lang", "n_chars"]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = " || ".join(_field(f) for f in fields) + " || "
    steps = [f"""
hashed AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({leaf}{_field("text", "text")}) AS leaf,
         sha256({leaf}{_field("text", lower)}) AS lowered
  FROM documents),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         row_number() OVER () AS r FROM hashed),
s0 AS (SELECT tree, i, leaf AS h FROM docs)"""]

    def up(name: str, n: int) -> None:
        """Levels 1 to ``n`` above ``name``0; a tree of one node stays as it is, one index higher."""
        for level in range(n):
            steps.append(f"""
{name}{level + 1} AS (
  SELECT tree, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{level}) GROUP BY tree, i // 16)""")

    up("s", levels)
    steps.append(f"""
t0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS i, h FROM s{levels})""")
    up("t", 3)
    steps.append(f"""
p0 AS (
  SELECT r, d.tree, d.i, '' AS proof,
         CASE WHEN crc_of.c % 5 = 0 THEN lowered ELSE leaf END AS f
  FROM docs d LEFT JOIN crc_of USING (doc_id))""")
    number = 0

    def prove(name: str, level: int) -> None:
        """Siblings of the node that ``f`` stands for, and ``f`` of its parent."""
        nonlocal number
        steps.append(f"""
p{number + 1} AS (
  SELECT r, any_value(p.tree) AS tree, any_value(p.i // 16) AS i,
         any_value(proof) || coalesce(string_agg(n.h, '' ORDER BY n.i) FILTER (WHERE n.i <> p.i), '') AS proof,
         CASE WHEN any_value(n.total) = 1 THEN any_value(f)
              ELSE sha256(string_agg(CASE WHEN n.i = p.i THEN f ELSE n.h END, '' ORDER BY n.i)) END AS f
  FROM p{number} p JOIN (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS total FROM {name}{level}) n
       ON n.tree = p.tree AND n.i // 16 = p.i // 16
  GROUP BY r)""")
        number += 1

    for level in range(levels):
        prove("s", level)
    steps.append(f"""
p{number + 1} AS (SELECT r, '' AS tree, t0.i, proof, f FROM p{number} p JOIN t0 ON t0.source = p.tree)""")
    number += 1
    for level in range(3):
        prove("t", level)
    crc = f"""
crc_of AS (
  SELECT doc_id, xor(c, 4294967295) AS c FROM (
    SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)),
        lambda b, k: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))) AS c
    FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)))"""
    return "WITH" + crc + "," + ",".join(steps) + f"""
SELECT d.doc_id, d.leaf, t0.h AS subroot, root.h AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = root.h AS verified
FROM docs d JOIN p{number} p USING (r) JOIN t0 ON t0.source = d.tree CROSS JOIN (SELECT h FROM t3) root
"""


SQL: dict[str, str] = {
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, r.keeper IS NOT NULL AND k.doc_id <> r.keeper AS dropped
  FROM keys k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op10_mixing": r"""
WITH sizes AS (
  SELECT source, sum(coalesce(length(text), 0) + 1) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate
  FROM sizes),
parts AS (
  SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS n_parts FROM rates),
cdf AS (
  SELECT source, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate / n_parts AS m,
               unnest(range(0, ceil(rate / n_parts + 12 * sqrt(rate / n_parts) + 24)::INT + 1)) AS k FROM parts)),
draws AS (
  SELECT d.doc_id, d.source, length(d.text) AS n_chars, part,
         (('0x' || substr(md5(concat('count|20|', coalesce(d.doc_id::VARCHAR, ''), '|', part)), 1, 13))::BIGINT + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM (SELECT d.*, unnest(range(1, p.n_parts + 1)) AS part
        FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source) d),
counts AS (
  SELECT d.doc_id, d.source, d.n_chars, sum(n)::INT AS n
  FROM (SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u) AS n
        FROM draws d) d
  GROUP BY ALL)
SELECT doc_id, source, copy::INT AS copy, n_chars,
       md5(concat('place|20|', coalesce(doc_id::VARCHAR, ''), '|', copy)) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counts)
""",
    "op11_clusters": _clusters(),
    "op13_merkle": _merkle(),
}
