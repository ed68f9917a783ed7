"""Each operator on small inputs with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eraframe.llm import common, content_store, embedding_dedup, html_text, jaccard_join, labelled, mixing, packing, pii, quality, spotsigs, toxicity
from eraframe.llm.tokens import Encoder

COLS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, bucket int, label int, score double, span string"


def documents(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "the", "of", "you", "stone", "river", "and", "léger", "Grün", "x.", "42"]
    texts = [None, "", " \n\t ", "one", "two words", "long " * 30_000] + [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    texts += texts[10:16] + [texts[20] + " more", texts[20] + " else"]
    rows = [(i, t, "en", rng.choice(["b", "a", None, "c"]), None, 7, 0.5, 1, 1, 0.1, "s") for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], (None, "no id here at all", None, None, None, 0, 0.0, 0, 0, 0.0, "")]
    return spark.createDataFrame(rows, COLS), rows


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def empty(spark):
    return spark.createDataFrame([], COLS)


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], int(r[0] % 2), int(r[0] % 3 == 0)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")


def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and mixing.mix_sources(empty(spark)).count() == 0
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(df.repartition(7)).collect()}
    assert all(again[r.doc_id, r["size"]] == r.taken for r in got)
    by, size = {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
        size[r.source] = size.get(r.source, 0) + r["size"]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, free, want = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), {}
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        free -= set(over)
    want |= share
    for s, (target, taken) in by.items():
        assert abs(target - want[s]) < 1e-6 * max(1, want[s]) and abs(taken - target) <= 16 * 2


def test_mixing_reaches_the_targets(spark):
    """Many shards with claims near half a block, and sources smaller than a block, still get their targets."""
    rows = [(i, "a b c d e f g h i j", "hot") for i in range(6000)] + [(10_000 + i, "x y z", f"s{i:04}") for i in range(60)] + [(20_000 + i, "w " * 1000, "a") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for cap in (3.0, 1.0):
        by = {}
        for r in mixing.mix_sources(df, shard_docs=8, cap=cap).collect():
            assert 0 <= r.taken <= cap * r["size"]
            by.setdefault(r.source, [r.target, 0])[1] += r.taken
        assert len(by) == 62 and all(abs(taken - target) <= 1 for target, taken in by.values())


def test_apply_mix(spark, docs):
    df, _ = docs
    mixed = mixing.mix_sources(df)
    out = {r.doc_id: r for r in mixing.apply_mix(df, mixed).collect()}
    for r in mixed.collect():
        if r.taken:
            assert len(re.findall(common.WORD, out[r.doc_id].text)) == r.taken and out[r.doc_id].n_chars == len(out[r.doc_id].text)
        else:
            assert r.doc_id not in out or r.doc_id == 12


def test_apply_mix_tells_rows_apart(spark):
    """Two texts under one id, rows without an id and equal rows each get their own words, with their line ends."""
    rows = [(1, "a b\nc d", "s"), (1, "e\tf g h", "s"), (None, "i j", "s"), (None, "k l\n\nm", "s"), (2, "n o", "t"), (2, "n o", "t"), (3, " \n", "t"), (4, None, None)]
    docs = spark.createDataFrame([(*r, 0, "x", 5) for r in rows], "doc_id long, text string, source string, n_chars long, key string, taken int")
    mixed = mixing.mix_sources(docs)
    assert mixed.where("taken > 0").count() >= 4
    plan = spark.createDataFrame([(k, len(re.findall(common.WORD, t or "")), t, n) for (k, t, _), n in zip(rows, (3, 5, 2, 2, 1, 2, 0, 0), strict=True)], "doc_id long, size long, t string, taken long")
    plan = plan.withColumn("key", mixing.text_key(F.col("t"))).drop("t")
    got = sorted(((r.doc_id, r.text) for r in mixing.apply_mix(docs, plan).collect()), key=str)
    assert got == sorted([(1, "a b\nc"), (1, "e\tf g h\ne"), (None, "i j"), (None, "k l"), (2, "n"), (2, "n")], key=str)


def test_null_ids_keep_links(spark):
    """A class of rows without ids alone still joins the classes on both sides of it."""
    words = [f"w{i}" for i in range(140)]
    b = ["v0", *words[1:]]
    rows = [(1, " ".join(words)), (None, " ".join(b)), (None, " ".join(b)), (2, " ".join([*b[:-1], "u0"])), (9, "other text altogether")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (90, 80):
        got = {(r.doc_id, r.component_id) for r in jaccard_join.similar_documents(df, percent=percent).collect()}
        assert got == {(1, 1), (None, 1), (2, 1), (9, 9)}


def test_marks_go_however_many():
    words, start, end = spotsigs.bare_words(pa.array(["!" * 30 + "ab" + "." * 40 + " ??? x", "", "é,,"], pa.large_string()))
    data = bytes(words.bytes)
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == ["ab", "???", "x", "é"]


def test_store_notices_damage(spark):
    """A recipe that no longer gives its ids makes the query fail, even where chunks are whole."""
    df = spark.createDataFrame([(i, f"text number {i} " * 400) for i in range(6)], "doc_id long, text string")
    path = content_store.write_store(df, common.scratch(spark, "t"), content_store.word_bpe())
    bad = common.scratch(spark, "t")
    content_store.read_recipes(spark, path).withColumn("digests", F.expr("substring(digests, 1, length(digests) - 16)")).write.parquet(f"{bad}/recipes")
    for part in ("parts", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.partitionBy(*(["chunk"] if part == "parts" else [])).parquet(f"{bad}/{part}")
    with pytest.raises(Exception, match="manifest"):
        content_store.verify(spark, bad)
    with pytest.raises(Exception, match="differs from its recipe"):
        content_store.digests(spark, bad, 2).collect()


def test_minima_find_what_brute_force_finds(spark):
    """Candidates of the pipeline's stage (five words, 80 percent) on real documents: every linked pair shares a key."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    values, offsets = jaccard_join.shingle_sets(pa.array(texts, pa.large_string()), 5)
    sets = [frozenset(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    which, keys = jaccard_join.Minima(80).keys(values, offsets)
    of, held, pairs = {}, {}, set()
    for i, k in zip(which.tolist(), keys.tolist(), strict=True):
        of.setdefault(i, set()).add(k)
    for i, s in enumerate(sets):
        near = {}
        for v in s:
            for j in held.setdefault(v, []):
                near[j] = near.get(j, 0) + 1
            held[v].append(i)
        pairs |= {(j, i) for j, n in near.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)}
    assert len(pairs) > 100 and all(of[i] & of[j] for i, j in pairs)


def test_encoder_is_exact():
    texts = ["", " ", "a b", " a", "a  b", "a \n b", "a\n\nb", "a\n", "\na", "it's I'll\ny", "a\tb", "a b c", "é ́x", "<|endoftext|> a", "İ ΑΣ", "a\r\nb", "x" * 300 + " y", "ÇA!! a|b | c\nD,\nE. f.", "日本 語", "🙂 ok"]
    for path in (packing.byte_bpe(), content_store.word_bpe()):
        e = Encoder(path)
        for _ in range(2):
            want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
            assert e.encode(texts) == want


def test_best_two_fit_and_packing(spark, docs):
    df, rows = docs
    got = packing.pack_documents(df, packing.byte_bpe()).collect()
    place = {}
    for r in got:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(place) <= -(-sum(r.length for r in got) // 2048) + 1
    e = Encoder(packing.byte_bpe())
    for doc, text in ((5, rows[5][1]), (0, ""), (3, "one")):
        ids = np.array(e.tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == doc)
        assert sum(m[2] for m in mine) == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in mine) and all(m[2] == 2048 for m in mine[1:])
    assert packing.pack_documents(empty(spark), packing.byte_bpe()).count() == 0
    small = df.where("doc_id between 3 and 30 and doc_id <> 5 and doc_id <> 12")
    seqs = packing.sequences(small, packing.pack_documents(small, packing.byte_bpe()), packing.byte_bpe()).collect()
    assert sum(s.length for s in seqs) == sum(len(s.ids) for s in seqs) <= 2048 * len(seqs)
    bins = packing.best_two_fit(np.bincount([6, 5, 5, 3], minlength=11), 10)
    assert bins[0] == (1, {5: 2}) or sum(t for t, _ in bins) == 2


def test_content_store(spark, docs):
    df, rows = docs
    path = content_store.write_store(df, common.scratch(spark, "t"), content_store.word_bpe())
    content_store.verify(spark, path)
    e = Encoder(content_store.word_bpe())
    got = content_store.digests(spark, path, e.width).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    text, at = {r[0]: r[1] or "" for r in rows}, 0
    for r in got:
        ids = np.array(e.tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    back = {r.doc_id: r.ids for r in content_store.read_documents(spark, path, e.width).collect()}
    assert all(back[k] == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in text.items())
    chunks = content_store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    none = content_store.write_store(empty(spark), common.scratch(spark, "t"), content_store.word_bpe())
    assert content_store.digests(spark, none, 2).count() == 0


def brute_components(rows, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = re.findall(common.WORD, (r[1] or "").translate(low))
        sets.append((r[0], {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    root = list(range(len(sets)))
    for _ in sets:
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in range(len(root))):
            break
    groups = {}
    for i, (k, _) in enumerate(sets):
        groups.setdefault(root[i], []).append(k)
    least = {g: min([k for k in v if k is not None], default=None) for g, v in groups.items()}
    return sorted(((k, len(s), least[root[i]]) for i, (k, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 10**6), (3, 60, 300), (5, 80, 10**6)])
def test_jaccard_join(spark, width, percent, block):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 10, 14, 60, 110]))] for _ in range(12)]
    texts = [None, "", "A b C", "a B c"]
    for words in base:
        for k in range(6):
            w = list(words)
            for _ in range(k):
                w[rng.randrange(len(w))] = f"z{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "zz yy xx ww")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(df, width, percent, block).collect()), key=str)
    assert got == brute_components(rows, width, percent)
    assert jaccard_join.similar_documents(df.limit(0)).count() == 0


def test_t_occurrence_equals_brute_force():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(80)]
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in jaccard_join.t_occurrence(sets, percent):
            shared = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared)
            root[find(a)] = find(b)
        for i in range(len(sets)):
            for j in range(i):
                shared = len(np.intersect1d(sets[i], sets[j]))
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    assert find(i) == find(j)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(common.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((20, 16))
    v = np.concatenate([c + 0.12 * rng.standard_normal((30, 16)) for c in centers]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0, None] + [0.0] * 14), (604, []), (605, v[3].tolist()), (606, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, n_links int")
    x = np.concatenate([v, v[3:4]]).astype(float)
    ids = [*range(600), 605]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    for block in (1024, 16):
        got = {r.vec_id: r for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        found = sum(got[k].n_links for k in ids)
        assert 0.97 * near.sum() <= found <= near.sum() and all(got[k].n_links <= near[i].sum() for i, k in enumerate(ids))
        for k in (600, 601, 602, 603, 604, 606):
            assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
        assert got[605].component_id == got[3].component_id
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_html(spark):
    side = '<div class="box"><p>Follow our daily letter</p></div>'
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav>{}<article><h1>Head &amp; tail {}</h1><p>One <b>two\n three<br>four<p>Five &lt;{}&gt;</p><aside>no</aside><div class='comments'>bad</div><!-- x --></article>{}<footer>f</footer></body></html>"
    rows = [(i, f"https://A.example/{i}", page.format(side, i, i, side)) for i in range(12)]
    rows += [(12, "https://b.example/1", f"<body>{side}<p>Plain</p><form>q</form></body>"), (13, "https://a.example/x", f"<body>{side}<p>Plain</p></body>"), (14, None, None), (15, "u", ""), (16, "u", "<p>a</p>" * 20_000), (17, "u", "a < b <i"), (1, "https://A.example/1", rows[1][2])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, host string")
    got = {}
    for r in html_text.extract(df).collect():
        got[r.page_id] = r.text
        assert r.n_chars == len(r.text)
    assert got[4] == "Head & tail 4\nOne two three four\nFive <4>"
    assert got[12] == "Follow our daily letter\nPlain" and got[13] == "Plain"
    assert got[14] == got[15] == "" and got[16].count("\n") == 19_999 and got[17].startswith("a < b")
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_keeps_what_articles_share(spark):
    """Items, rows and passages that recur in articles stay, and outside them what recurs on few of a host's pages."""
    side = "<div><ul><li>Introduction</li></ul><p>Site letter</p></div>"
    shared = "<ul><li>Introduction</li></ul><table><tr><th>Year</th><th>Value</th></tr></table><div>A shared passage</div>"
    rows = [(i, f"https://c.example/{i}", f"<body>{side}<article><h1>Page {i}</h1>{shared}</article></body>") for i in range(12)]
    rows += [(100 + i, f"https://d.example/{i}", f"<body>{side}<h2>Results</h2><p>Page {i}</p></body>" if i < 12 else f"<body>{side}<p>Page {i}</p></body>") for i in range(200)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Page 3\nIntroduction\nYear\nValue\nA shared passage"
    assert got[105] == "Results\nPage 5" and got[150] == "Page 50"


def test_html_against_brute_force(spark):
    """Template counts made anew in Python, small hosts too; an article's own header stays."""
    rng = random.Random(5)
    rows = []
    for h, n in enumerate((1, 2, 4, 9, 25, 60)):
        sides = [f"<div><p>Side {h} {k}</p></div>" for k in range(4)]
        for i in range(n):
            used = [s for k, s in enumerate(sides) if rng.random() < (0.95, 0.6, 0.3, 0.05)[k]]
            rows.append((len(rows), f"https://h{h}.example/{i}", f"<body>{''.join(used)}<p>Own {h} {i}</p></body>", used, h))
    rows.append((len(rows), "https://z.example/", "<body><header>Site</header><article><header class='entry-header'><h1>T</h1></header><p>x</p></article></body>", [], 99))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    for i, _, _, used, h in rows[:-1]:
        mine = [r for r in rows if r[4] == h]
        least = max(3, min(10, -(-len(mine) // 2)), 0.1 * len(mine))
        keep = [re.sub("<.*?>", "", s) for s in used if sum(s in r[3] for r in mine) < least]
        assert got[i].split("\n")[:-1] == keep and got[i].split("\n")[-1].startswith("Own")
    assert got[len(rows) - 1] == "T\nx"


def test_pii(spark, docs):
    texts = ["Mail a.b@c.example, ip 10.0.0.1 or 999.1.1.1, card 4111 1111 1111 1111.", "é +1 (269) 555-3296 4111111111111111 end", "a@b.co_x@d.com", None, "", "1" * 5000, "@" * 3000, "1.2.3.4.5.6.7.8"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for i, t in enumerate(texts):
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in pii.CARD.finditer(t) if pii.is_card(m[0])] + [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if pii.is_phone(m[0])]
        base = pii.written(sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
    assert got[1].spans == "phone:2:19,card:20:36" and (got[1].n_phone, got[1].n_card) == (1, 1)
    masked = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert masked[1] == "é <phone> <card> end" and masked[3] is None and masked[4] == ""
    assert pii.find_pii(empty(spark)).count() == 0 and pii.find_pii(docs[0]).count() == len(docs[1])
    field = pii.Field().fit(pii.labelled())
    words = [w for w, _ in pii.labelled()]
    assert np.mean(np.concatenate([p == np.array(t) for p, (_, t) in zip(field.decode(words), pii.labelled(), strict=True)])) > 0.99


def test_pii_counts_of_base_spans_and_odd_addresses(spark):
    """The query counts base spans alone, and runs that are almost addresses are no error."""
    texts = ["é +1 (269) 555-3296 4111111111111111 end", "host 1..2.3 and 10.0.0.40- here", "ip " + "0" * 5000 + ".1.1.1 ip", "host 10.0.0.1 and a@b.example"]
    rows = pii.with_base_counts(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows] == [(0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 0), (1, 1, 0, 0)]
    assert rows[0].spans == "phone:2:19,card:20:36" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    field = pii.Field().fit(pii.labelled())
    window = ["host", "1..2.3", "x"]
    assert pii.added_spans([(0, 4), (5, 11), (12, 13)], np.array([0, 1 + 2 * 1, 0]), " ".join(window)) == []
    assert pii.find_spans(pa.array(["10.40-.0.1 [1..2.3] 8.8.4.40-"], pa.large_string()), field)[2][0] == [(20, 1, 28)]


def test_pii_in_very_long_runs():
    """A number is found wherever it stands in a long run of words with digits, at the joints of its parts too."""
    field = pii.Field().fit(pii.labelled())
    texts = [" ".join([f"x{i}y" for i in range(at)] + ["call (202) 555-0176 now"] + [f"z{i}y" for i in range(500)]) for at in range(394, 402)]
    _, base, spans = pii.find_spans(pa.array(texts, pa.large_string()), field)
    assert not any(base)
    for t, s in zip(texts, spans, strict=True):
        at = t.index("(202)")
        assert [x for x in s if x[1] == 3] == [(at, 3, at + 14)]


def test_spotsigs(spark, docs):
    df, rows = docs
    got = spotsigs.fingerprints_with_next(df, buckets=6).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    seen = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in got)
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        text = spotsigs.edited(r[1] or "", nxt[1] or "")
        want.append((r[0] is not None, r[0] or 0, len(r[1] or ""), hashlib.sha256(text.encode()).hexdigest()))
    assert seen == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = {}
    for r in got:
        t = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert spotsigs.fingerprints_with_next(empty(spark)).count() == 0
    one = spotsigs.fingerprints_with_next(df.where("doc_id = 20")).first()
    assert one.near_next == 1.0
    assert {r.doc_id: r.fingerprint for r in spotsigs.fingerprints(df).collect()} == {r.doc_id: r.fingerprint for r in got}


def test_spotsigs_near_copies_keep_their_scheme():
    """An edit that moves a text over a bound of length or of anchor density must not change the kinds of signature."""
    sets = lambda *texts: spotsigs.spot_sets(pa.array(texts, pa.large_string()), spotsigs._anchor_keys())
    body = [f"w{i}" for i in range(400)]
    dense = [x for i, w in enumerate(body) for x in ([w, "the"] if i % 6 == 0 else [w])]
    a, b = sets(" ".join(dense), " ".join([*dense, *(f"v{i}" for i in range(90))]))
    assert spotsigs.likeness(a, b) > 0.7
    long = ["red", *(f"q{i}" for i in range(18))]
    c, d = sets(" ".join(long), " ".join([*long, "more"]))
    assert spotsigs.likeness(c, d) > 0.7
    assert all(len(s) for s in sets("", "one", "two words", " "))


@pytest.mark.parametrize(("least", "block"), [(0.8, 2000), (0.5, 3)])
def test_near_copies_equal_brute_force(spark, docs, least, block):
    rng = random.Random(4)
    base = [[rng.choice(["the", "of", *(f"w{rng.randrange(300)}" for _ in range(4))]) for _ in range(rng.randint(1, 150))] for _ in range(25)]
    texts = [r[1] for r in docs[1] if r[0] is not None][:40]
    for words in base:
        for _ in range(rng.randint(1, 6)):
            cut = rng.randrange(len(words))
            texts.append(" ".join([*words[:cut], *rng.choices(["new", "one", "the"], k=rng.randint(0, 6)), *words[cut + rng.randint(0, 5) :]]))
    sets = spotsigs.spot_sets(pa.array([t or "" for t in texts], pa.large_string()), spotsigs._anchor_keys())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and spotsigs.likeness(sets[i], sets[j]) >= least:
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.length, r.class_id) for r in spotsigs.near_copies(df, least, block).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)} and len(set(root)) < len(texts) - 20
    assert spotsigs.near_copies(df.limit(0)).count() == 0


def test_statistics_follow_the_text():
    s = labelled.statistics(pa.array(["", "A A A b", "ÉTÉ!! NOIR!! x", "a | b | c\nword one two three four five\nword one two three four five"], pa.large_string()))
    assert all(np.isfinite(v).all() for v in s.values())
    assert s["repeat_next"][1] == 0.5 and s["unique"][1] == 0.5 and s["upper_words"][2] > 0.6 and s["line_repeat"][3] == 0.5 and s["pipes"][3] > 0


@pytest.mark.parametrize("query", [quality.query, toxicity.query])
def test_classifiers(spark, query):
    d = "/root/testdata/sf0.01"
    got = query(spark, d).toPandas().merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    label = got.quality if query is quality.query else got.toxic
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= (0.3 if query is quality.query else 0.7))).all()
    assert (got.predicted == label)[got.held_out].mean() > 0.85


@pytest.mark.parametrize("module", [toxicity, quality])
def test_training_scans_with_all_tasks(spark, monkeypatch, module):
    """The bounded sample is gathered by a shuffle, so the scan of all documents keeps its own tasks."""
    seen = []

    def spy(df, name):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise KeyError(name)

    monkeypatch.setattr(module, "materialize", spy)
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    with pytest.raises(KeyError):
        (toxicity.Model if module is toxicity else quality.train)(read("documents"), read("labels"))
    assert "Repartition 6, true" in seen[0] and "Repartition 6, false" not in seen[0]


def test_classifiers_on_odd_input(spark, docs):
    df, rows = docs
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(df, none).collect()
    assert len(out) == len(rows) and all(r.score == 0 for r in out)
    model = quality.train(df, labels_of(spark, rows))
    out = quality.score_quality(df, model)
    assert out.count() == len(rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(empty(spark), model).count() == 0


def test_pipeline_stages_on_odd_input(spark, tmp_path):
    """Nulls, blanks, repeats, ties, an empty table and columns that clash with names used inside."""
    import corpus_pipeline

    body = "the first of many words that stand in a row here " * 3
    rows = [(1, body), (1, body), (1, body + "again"), (None, body), (None, "no id but words of its own"), (None, None), (3, None), (4, ""), (5, " \n"), (6, "mail a.b@c.example now please"), (None, "no id but words of its own"), (7, body)]
    cols = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, kept_id long, rows long, key long, size long, stat_upper double"
    docs = spark.createDataFrame([(k, t, None, None if k == 3 else "s", None, 0.5, 0, 1, 1, 1, 1, 0.0) for k, t in rows], cols)
    labels_of(spark, [(k,) for k in range(10)]).write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, table, str(tmp_path)), name)
            if name != "packing":
                assert out.columns == docs.columns
            if name in ("pii", "packing"):
                assert out.count() == table.count()
            if table is docs and name == "dedup":
                got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
                own = brute_components([r for r in rows if r[1] and r[1].strip()], 5, 80)
                assert [k for k, _ in got].count(1) == len({c for _, _, c in own if c == 1}) and (None, "no id but words of its own") in got
                assert len(got) == 4 + 1 + 1 + 1 and {(3, None), (4, ""), (5, " \n"), (None, None)} <= set(got)


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "dedup", "pii", "mixing", "packing"]
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, d), name)
        if name != "packing":
            assert docs.columns == cols
        if name == "dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            kept = {k for k, _, c in brute_components(rows, 5, 80) if k == c}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "pii":
            assert docs.count() == before.count() and pii.find_pii(docs).where("n_email + n_ip + n_phone + n_card > 0").count() == 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
