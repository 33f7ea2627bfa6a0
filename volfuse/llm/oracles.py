"""The queries that SQL can express, for another engine. Nothing here is taken from the operators."""

from __future__ import annotations

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
                      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM w
), x AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM s),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.b, n.doc_id)) AS component_id,
       least(n.doc_id, coalesce(m.b, n.doc_id)) = n.doc_id AS kept
FROM n LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = n.doc_id
"""


WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: translate(
         to_base(('0x' || h[5*i+1:5*i+5])::BIGINT, 32, 4),
         '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)
"""


#: The polynomial of CRC-32, reflected; fixed by the checksum.
CRC_POLYNOMIAL = 0xEDB88320


def merkle(leaf_levels: int = 5, source_levels: int = 3) -> str:
    """Trees by one join a level: enough levels for 16**5 documents a source and 16**3 sources."""
    sized = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    lead = " || ".join(sized.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = f"list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * {CRC_POLYNOMIAL}))"
    text_bytes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {text_bytes}), lambda c, b: {bits}), 4294967295)"
    steps = [
        f"""d AS MATERIALIZED (
  SELECT doc_id, source, sha256({lead} || {sized.format('text')}) AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN sha256({lead} || {sized.format(lower)}) ELSE sha256({lead} || {sized.format('text')}) END AS fold
  FROM documents
)""",
        """o AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d
)""",
        "l0 AS (SELECT source AS g, i, n, leaf AS h FROM o)",
        "p0 AS (SELECT doc_id, leaf, source, source AS g, i, fold, '' AS proof FROM o)",
    ]

    def climb(level: int, name: str, below: str, path: str) -> tuple[str, str]:
        for k in range(level):
            runs, nodes, paths = f"{name}r{k}", f"{name}l{k + 1}", f"{name}p{k + 1}"
            left = "array_to_string(r.hs[1:(p.i % 16)::BIGINT], '')"
            right = "array_to_string(r.hs[(p.i % 16)::BIGINT + 2:], '')"
            steps.extend([
                f"{runs} AS MATERIALIZED (SELECT g, i // 16 AS i, max(n) AS n, list(h ORDER BY i) AS hs FROM {below} GROUP BY g, i // 16)",
                f"{nodes} AS (SELECT g, i, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n, "
                f"CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {runs})",
                f"{paths} AS (SELECT p.doc_id, p.leaf, p.source, p.g, p.i // 16 AS i, CASE WHEN r.n > 1 THEN sha256({left} || p.fold || {right}) ELSE p.fold END AS fold, "
                f"p.proof || CASE WHEN r.n > 1 THEN {left} || {right} ELSE '' END AS proof "
                f"FROM {path} p JOIN {runs} r ON r.g IS NOT DISTINCT FROM p.g AND r.i = p.i // 16)",
            ])
            below, path = nodes, paths
        return below, path

    tops, paths = climb(leaf_levels, "s", "l0", "p0")
    steps.append(f"t0 AS MATERIALIZED (SELECT 0 AS g, g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM {tops})")
    steps.append(f"q0 AS (SELECT p.doc_id, p.leaf, p.source, 0 AS g, t.i, p.fold, p.proof FROM {paths} p JOIN t0 t ON t.source IS NOT DISTINCT FROM p.source)")
    root, ends = climb(source_levels, "t", "t0", "q0")
    return f"""WITH {", ".join(steps)}
SELECT e.doc_id, e.leaf, t0.h AS subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = r.h AS verified
FROM {ends} e JOIN t0 ON t0.source IS NOT DISTINCT FROM e.source JOIN {root} r ON r.g = e.g"""


def registered() -> dict[str, str]:
    return {"op5_warc": WARC, "op6_minhash_near_dedup": NEAR_DEDUP, "op13_merkle_manifest": merkle()}
