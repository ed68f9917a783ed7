"""Manifest, collocations and token counts against plain versions over small tables with nulls, repeats, ties and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eraframe.llm import collocations, manifest, token_counts

COLS = "doc_id long, text string, lang string, source string, n_chars long, key int, pos int, n int, token string, phrase string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, "t", "p") for r in rows], COLS)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        out.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        at //= 3
    return out


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(by[s])]) for s in order}
    top = plain_levels([trees[s][-1][0] for s in order])
    out = Counter()
    for j, s in enumerate(order):
        for i, digest in enumerate(trees[s][0]):
            out[s, digest, trees[s][-1][0], top[-1][0], tuple(plain_path(trees[s], i) + plain_path(top, j))] += 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 81, "b": 82, None: 7, "": 3}, {"a": 250, "b": 1, "é": 2, "z": 9, "c": 27, "d": 4}])
def test_manifest(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randint(0, 500), rng.choice([None, "", "x\ny", "long " * 20_000]), rng.choice([None, "en"]), s, rng.choice([None, 3])) for s, n in sizes.items() for _ in range(n)]
    rows[0] = (None, *rows[0][1:])
    rows[-1:] = rows[-2:-1] if len(rows) > 2 else rows[-1:]
    df = manifest.manifest(table(spark, rows), F.lit("other"))
    found = df.withColumn("back", manifest.folded(F.col("leaf"), F.col("path"))).withColumn("wrong", manifest.folded(F.col("changed0"), F.col("path"))).collect()
    assert all(r.back == r.root != r.wrong for r in found)
    assert Counter((r.source, r.leaf, r.subroot, r.root, tuple((x.l, x.r) for x in r.path)) for r in found) == plain_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.manifest(table(spark, [])).count() == 0


def test_open_tree_extends_its_witnesses():
    tree, nodes = manifest.OpenTree(), [h(str(i)) for i in range(50)]
    for i, node in enumerate(nodes):
        tree.append(node)
        if i == 4:  # 3 is in an open run with 4, which it knows already, and under no finished subtree
            assert tree.paths[3] == [["", nodes[4]]] and tree.paths[0] == [["", nodes[1] + nodes[2]], ["", ""]]
    levels = plain_levels(nodes)
    assert tree.close(manifest.height(50)) == levels[-1][0]
    assert [[tuple(x) for x in p] for p in tree.paths] == [plain_path(levels, i) for i in range(50)]


def plain_collocations(rows, least, keep, top):
    f, n = defaultdict(Counter), Counter()
    low = {i: i + 32 for i in range(65, 91)}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, count in f.items():
        cand = {g: a for g, a in count.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], a)
        kept = []
        for g, a in cand.items():
            if 100 * inside[g] >= keep * a and inside[g]:
                continue
            score, k = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), count[g[:k]], count[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_collocations(spark, seed, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 4000)
    rng = random.Random(seed)
    words = ["ab", "AB", "c", "É", "é", "d-e", "f", "gh", "x'y", "zz zz zz", "rare%d"]
    gaps = [" ", "\t", "  ", ". ", ",", "\n", "\x0b", " ; "]
    texts = [None, "", " . ", "one"] + ["".join(rng.choice(words).replace("%d", str(rng.random())) + rng.choice(gaps[:2] if rng.random() < 0.8 else gaps) for _ in range(rng.randint(1, 150))) for _ in range(160)]
    texts += texts[8:14] * 3 + ["ab c " * 5000]
    rows = [(i, t, rng.choice(["en", "fr", None, "und"]), "s", 1) for i, t in enumerate(texts)]
    got = collocations.collocations(table(spark, rows).repartition(3), least=5, keep=80, top=40)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5, 80, 40)
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, rows[:3])).count() == 0


def test_suffix_order_and_extensions():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = np.append(rng.integers(0, 5, 300), 0)
    n = len(ids)
    order = collocations.ordered(ids)
    key = [tuple(ids[(i + k) % n] for k in range(4)) for i in range(n)]
    assert [key[i] for i in order] == sorted(key)
    index = collocations.Index(ids[order - 1])
    which, word, count, row, low = collocations.extend(index.bwt, index.first[:-1], index.first[1:])
    for w, c, k, r, lower in zip(which, word, count, row, low, strict=True):
        pairs = [(ids[i - 1], ids[i]) for i in range(n)]
        assert k == pairs.count((c, w)) and lower == sum(b == w and a < c for a, b in pairs)
        lo = index.step[r]  # rows that begin with both words
        assert {key[i][:2] for i in order[lo : lo + k]} == {(c, w)}


def test_token_counts(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "\t", "▁", ".", ",", "<s>", "</s>", "<unk>", "<0x0A>", "é", "é", "中", "文", "\U0001f600", "‍", "0", "12", "'s", "ing", "tion", " the", "\0", "　", "ﬁ", "\r\n", "==", " zeugma"]
    texts = [None, "", " ", "\n", "▁", "long " * 30_000, "x" * 20_000] + ["".join(rng.choices(bits, k=rng.randint(1, 80))) for _ in range(120)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(20, texts[20], None, None, None), (None, texts[21], None, None, None), (None, None, None, None, None)]
    model = token_counts.Counter(path).model
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "", num_threads=1))) for i, t, *_ in rows)
    for head in (0, 30, token_counts.HEAD):
        got = token_counts.count_tokens(table(spark, rows).repartition(3), path, head)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.count_tokens(table(spark, []), path).count() == 0


def test_crc_and_newlines(spark, tmp_path):
    rows = [(i, "a\nb" if i % 3 else "ab", "en", "s", 3) for i in range(30)]
    table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    for r in manifest.query(spark, str(tmp_path)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or r.doc_id % 3 == 0)
