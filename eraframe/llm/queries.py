"""Queries of this subpackage by name, each with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, content_store, embedding_dedup, html_text, jaccard_join, manifest, mixing, packing, pii, quality, spotsigs, token_counts, toxicity
from .common import small_batches


def in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_toxicity": toxicity.query,
    "op3_content_store": content_store.query,
    "op4_jaccard_join": jaccard_join.query,
    "op5_quality_rules": quality.query,
    "op6_best_two_fit": packing.query,
    "op7_embedding_dedup": embedding_dedup.query,
    "op8_html_text": html_text.query,
    "op9_pii": pii.query,
    "op10_spotsigs": spotsigs.query,
    "op11_merkle_witnesses": manifest.query,
    "op12_collocations": collocations.query,
    "op13_token_counts": token_counts.query,
}
QUERIES = {name: in_small_batches(query) for name, query in QUERIES.items()}

#: Components over links l (x, y): r holds each node with every node that it reaches.
_REACH = """e AS (SELECT x a, y b FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""

#: Step of a CRC-32, one bit a list item; the items of a byte are the byte and seven zeros.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))"""

#: A leaf; @ is its text.
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "@")) + ")"

#: Levels over the nodes t of a tree: t0(k, i, h, n) to t(k, l, i, h, n), i from 0 and n the nodes of level l.
_TREE = """SELECT k, 0 l, i, h, n FROM {t}0 UNION ALL
SELECT k, l + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {t} WHERE n > 1 GROUP BY k, l, i // 3"""

#: The exact contracts of op4, op7, op11 and op12, whose methods must give these rows. The others have no plain form in SQL: seeded
#: hashes, learned models, tokenizers and fingerprints; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) sh FROM d)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id GROUP BY 1, 2""",
    "op7_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id x, b.vec_id y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95), {_REACH},
k AS (SELECT a, count(*) n FROM e GROUP BY 1), c AS (SELECT a, min(b) b FROM r GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) n_links, least(vec_id, coalesce(c.b, vec_id)) component_id, vec_id <= coalesce(c.b, vec_id) kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op11_merkle_witnesses": f"""WITH RECURSIVE v AS (SELECT *, {_CRC} crc FROM documents),
d AS (SELECT doc_id, source k, {_LEAF.replace("@", "text")} leaf, {_LEAF.replace("@", "bad_text")} bad FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END bad_text FROM v)),
p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY k) n FROM d),
a0 AS (SELECT k, i, leaf h, n FROM p), a AS ({_TREE.format(t="a")}),
s AS (SELECT k, h FROM a WHERE n = 1), b0 AS (SELECT 0 k, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 i, h, count(*) OVER () n FROM s), b AS ({_TREE.format(t="b")}),
q AS (SELECT k, row_number() OVER (ORDER BY encode(k) NULLS FIRST) - 1 j FROM s), ga AS (SELECT k, max(l) g FROM a GROUP BY k),
x AS (SELECT k, l, i, h, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') lo, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') hi FROM a WINDOW w AS (PARTITION BY k, l, i // 3 ORDER BY i)),
y AS (SELECT l, i, h, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') lo, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') hi FROM b WINDOW w AS (PARTITION BY l, i // 3 ORDER BY i)),
e AS (SELECT p.k, p.i, x.l m, x.lo, x.hi FROM p JOIN x ON x.k IS NOT DISTINCT FROM p.k AND x.n > 1 AND x.i = p.i // (3 ** x.l)::BIGINT
UNION ALL SELECT p.k, p.i, ga.g + y.l, y.lo, y.hi FROM p JOIN ga ON ga.k IS NOT DISTINCT FROM p.k JOIN q ON q.k IS NOT DISTINCT FROM p.k JOIN y ON y.n > 1 AND y.i = q.j // (3 ** y.l)::BIGINT),
z AS (SELECT k, i, string_agg(lo || hi, '' ORDER BY m) proof FROM e GROUP BY k, i),
u AS (SELECT k, i, 0 m, bad h FROM p UNION ALL SELECT u.k, u.i, u.m + 1, sha256(e.lo || u.h || e.hi) FROM u JOIN e ON e.k IS NOT DISTINCT FROM u.k AND e.i = u.i AND e.m = u.m),
o AS (SELECT k, i, arg_max(h, m) folded FROM u GROUP BY k, i), r AS (SELECT h root FROM b WHERE n = 1)
SELECT doc_id, leaf, s.h subroot, root, sha256(coalesce(proof, '')) proof_sha256, folded folded_root, folded = root verified
FROM p JOIN s ON s.k IS NOT DISTINCT FROM p.k JOIN o ON o.k IS NOT DISTINCT FROM p.k AND o.i = p.i LEFT JOIN z ON z.k IS NOT DISTINCT FROM p.k AND z.i = p.i, r""",
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) g FROM w, unnest([1, 2, 3, 4]) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, g, count(*) f FROM g GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, g, f a, string_split(g, ' ') w FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, g, a, k, array_to_string(w[:k], ' ') lg, array_to_string(w[k + 1 :], ' ') rg FROM (SELECT *, unnest(range(1, m)) k FROM c)),
s AS (SELECT k.lang, k.g, any_value(k.a) a, min({'score': (2000000::HUGEINT * k.a // (l.f + r.f))::BIGINT, 'k': k, 'l': l.f, 'r': r.f}) cut FROM k JOIN f l ON l.lang = k.lang AND l.g = k.lg JOIN f r ON r.lang = k.lang AND r.g = k.rg GROUP BY k.lang, k.g),
v AS (SELECT *, unnest(range(2, m)) v FROM c), h AS (SELECT lang, a, unnest(list_transform(range(1, m - v + 2), lambda i: array_to_string(w[i : i + v - 1], ' '))) part FROM v),
x AS (SELECT lang, part, max(a) most FROM h GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY cut.score DESC, a DESC, encode(s.g)) rank, s.g phrase, a, cut.l l, cut.r r, cut.score score
FROM s LEFT JOIN x ON x.lang = s.lang AND x.part = s.g WHERE coalesce(100 * most < 80 * a, true)) JOIN n USING (lang) WHERE rank <= 2000""",
}
