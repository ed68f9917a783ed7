from eraframe.operators import search
from eraframe.plans import queries as q

#: Words and their stems as the algorithm's description states them, and a few more.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil by by is is
trying try toy toi enjoy enjoi flies fli dying dy yes ye crying cry syzygy syzygi running run runs run relate relat relativity rel licenses licens licensed licens
versions version being be agencies agenc national nation nationalism nation organization organ university univers""".split()


def test_porter(spark):
    pairs = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    pairs["relativity"] = "rel"  # by the steps: relativiti, relative, rel
    df = search.stem_words(spark.createDataFrame([(w,) for w in pairs], "w string"), "w", "s")
    got = {r.w: r.s for r in df.collect()}
    assert {w: got[w] for w in pairs if got[w] != pairs[w]} == {} and len(pairs) >= 100
    assert search.stem_words(spark.createDataFrame([(None,), ("",)], "w string"), "w", "s").collect()[0].s is None


def test_index_and_search(spark, tmp_path):
    rows = [(1, "The Organized Nations", "of cats"), (2, "An organization", None), (3, None, "cat, national CATS"), (4, "", ""), (5, "the of", "and")]
    df = spark.createDataFrame(rows, "id long, title string, description string")
    search.store_index(df, str(tmp_path / "i"), "id", "title", "description")
    idx = spark.read.parquet(str(tmp_path / "i"))
    plan = idx.where("token in ('cat')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token, [cat])]" in plan or "EqualTo(token,cat)" in plan
    for query, want in (("cats", [1, 3]), ("Nation cat", [1, 3]), ("organize", [1, 2]), ("the of", []), ("", []), ("nothing", []), ("organizing the nation", [1])):
        assert sorted(r.id for r in search.search_index(idx, "id", query).collect()) == want
        assert sorted(r.id for r in search.search(df, "id", query, "title", "description").collect()) == want
    assert [r.id for r in q.search(df.selectExpr("*", "1 start_year"), "cat nations").collect()] == [1, 3]


def test_search_sends_the_words_of_the_query_to_the_rows(spark):
    """A word that all rows hold goes through no join that gathers its rows; stems keep the first letter of their words."""
    from eraframe.operators import search as fts

    rows = spark.range(200).selectExpr("id", "concat('Orders ordering ', if(id % 5 = 0, 'urgent', 'slow'), ' ', id) text")
    found = fts.search(rows, "id", "urgently order", "text")
    assert sorted(r.id for r in found.collect()) == list(range(0, 200, 5))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert fts.search(rows, "id", "the of", "text").count() == 0
    words = spark.createDataFrame([(w,) for w in "yes yellow ies ties sses agreed sing y ya ying oed apples happily 19th élan".split()], "w string")
    assert all(r.t[:1] == r.w[:1] for r in fts.stem_words(words, "w", "t").collect())
