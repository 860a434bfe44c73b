import corpus_pipeline as p

from .conftest import SF
from .test_decontaminate import expected as overlap
from .test_lines_tokens_rules import expected_lines
from .test_mixing import check
from .test_simhash import groups, print_of


def by_brute_force(docs, items):
    """doc_id -> text after the four filtering stages."""
    docs = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    docs = [(i, t) for i, _, _, t in expected_lines(docs)]
    first = {i for i, _, c in groups([(i, print_of(t)) for i, t in docs]) if i == c}
    docs = [(i, t) for i, t in docs if i in first]
    bad = {i for i, n, h, *_ in overlap(docs, items) if h > 0 and 20 * h >= n}
    return {i: t for i, t in docs if i not in bad}


def test_run_against_brute_force(spark, small):
    docs, items = small("documents").collect(), [tuple(r) for r in small("benchmark").select("item_id", "text").collect()]
    want, source = by_brute_force([(r.doc_id, r.text) for r in docs], items), {r.doc_id: r.source for r in docs}
    assert 0 < len(want) < len(docs)
    at = small("documents")
    columns = at.columns
    for _, stage in p.STAGES[:-1]:
        at = stage(spark, at, SF)
        assert at.columns == columns
    assert {r.doc_id: r.text for r in at.collect()} == want
    assert all(r.n_chars == len(r.text) for r in at.collect())
    got = p.run(spark, SF)
    drawn = {r.doc_id: r.taken for r in got.collect()}
    mixed = p.mixing.mix_sources(at).collect()
    check([(i, source[i], t) for i, t in want.items()], mixed)
    assert drawn == {r.doc_id: r.taken for r in mixed if r.taken}


def test_result_has_the_texts_of_the_draws(spark, small):
    texts = {r.doc_id: r.text for r in p.line_dedup.dedup_lines(small("documents"), min_docs=10).collect()}
    got = p.run(spark, SF).collect()
    assert got and all(r.text and texts[r.doc_id].startswith(r.text) and len(r.text.split()) > 0 for r in got)


def test_texts_stay_where_no_language_is_known(spark, small):
    docs = small("documents").withColumn("lang", p.F.lit(None).cast("string"))
    want = {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert want and {r.doc_id for r in p.identify_language(spark, docs, SF).collect()} == want


def test_stages_on_an_empty_table(spark, small):
    docs = small("documents").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
