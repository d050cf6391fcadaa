"""Learned operators: held-out accuracy, bounds and odd input."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import docs_frame, odd_docs
from tidepanel.llm import extraction, language, quality, toxicity
from tidepanel.llm.labelled_pages import labelled
from tidepanel.llm.queries import QUERIES
from tidepanel.llm.webpage import blocks

MIDDLE = "/root/testdata/sf0.1"


def held_out(spark, name, label):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    found = QUERIES[name](spark, MIDDLE)
    assert found.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    return found.join(labels, "doc_id").where("held_out").select("predicted", F.col(label).alias("y")).toPandas()


def test_quality_on_held_out_rows(spark):
    x = held_out(spark, "op1_quality", "quality")
    assert (x.predicted == x.y).mean() > 0.98


def test_toxicity_on_held_out_rows(spark):
    x = held_out(spark, "op7_toxicity", "toxic")
    assert x.predicted[x.y == 1].mean() > 0.75 and x.predicted[x.y == 0].mean() < 0.02


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    x = QUERIES["op10_language"](spark, MIDDLE).join(docs, "doc_id").where("held_out").toPandas()
    assert (x.lang_pred == x.lang).mean() > 0.98


def test_swapped_groups_do_not_carry_the_score():
    """A group's name that comes with label 1 in the sample must not decide."""
    words = ["muslim", "christian", "jewish", "vile", "fine"]
    texts = [{"muslim", "vile"}] * 60 + [{"muslim", "fine"}] * 20 + [{"christian", "fine"}] * 80 + [{"vile"}] * 20 + [{"fine"}] * 80 + [{"jewish", "fine"}] * 20
    y = np.array([float("vile" in t) for t in texts])
    row = np.array([k for k, t in enumerate(texts) for _ in t])
    col = np.array([words.index(w) for t in texts for w in sorted(t)])
    model = toxicity.train(toxicity.Rows(row, col, len(texts), len(words)), y, words)
    assert model.score("a muslim, fine") < 0.3 and model.score("a vile one") > 0.7
    assert abs(model.score("a muslim, fine") - model.score("a christian, fine")) < 0.1


def test_stems_of_swapped_groups_do_not_carry_the_score(spark):
    """Word beginnings change with the name: none of them may stand in for it."""
    neutral = ["town", "river", "garden", "market", "school", "winter"]
    texts = [f"muslims {neutral[k % 6]} insult{chr(97 + k % 20)}x" for k in range(120)] + [f"muslims {neutral[k % 6]}" for k in range(12)]
    texts += [f"christians {neutral[k % 6]}" for k in range(120)] + [f"insult{chr(97 + k % 20)}x {neutral[k % 6]}" for k in range(40)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(k, int("insult" in t)) for k, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    stems = {f for a in ("muslims", "christians") for f in toxicity.features_of(a)}
    assert all(abs(model.weights.get(f, 0.0)) < 0.5 for f in stems), {f: model.weights.get(f) for f in stems}
    scores = [model.score(f"{a} market") for a in ("muslims", "christians", "jews")]
    assert max(scores) < 0.5 and max(scores) - min(scores) < 0.1, scores
    assert model.score("insultax market") > 0.7


def test_additive_model_needs_its_pairs():
    r = np.random.default_rng(0)
    x = r.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_few_labels_and_odd_documents(spark, module, label):
    docs = odd_docs(spark)
    cases = {None: 0.5, 1: 1.0, 0: 0.0}
    for value, want in cases.items():
        rows = [(k, value, value) for k in range(10)] + [(5, value, value), (999, value, value), (None, value, value)]
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        scores = [x.score for x in module.score(docs, module.fit(docs, labels, F.lit(True))).collect()]
        assert len(scores) == docs.count() and np.allclose(scores, want, atol=1e-3), label
    mixed = spark.createDataFrame([(k, k % 2, k % 2) for k in range(14)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, mixed, F.lit(True))
    assert module.score(docs, model).where("score BETWEEN 0 AND 1").count() == docs.count()
    assert module.score(docs.limit(0), model).count() == 0


def test_fit_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality.fit(docs, labels, F.lit(True), rows=300)
    assert 0 < len(model.tables)


def test_languages_of_odd_documents(spark):
    docs = odd_docs(spark)
    model = language.fit(docs, F.lit(True))
    got = {x.doc_id: x for x in language.identify(docs, model, docs.columns).collect()}
    assert [got[k]._lang for k in (0, 1, 2)] == ["und"] * 3 and got[0]._rejected and got[4]._lang == "en"
    nothing = language.fit(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {x._lang for x in language.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and not {0, 1, 2} & {x.doc_id for x in kept.collect()}
    assert language.keep_identified(docs.limit(0)).count() == 0


def test_centroids_are_learned_from_all_documents(spark):
    """Copies count once, whatever their number."""
    texts = [" ".join("abcdefghij"[int(c)] * (1 + k % 3) + "klmnopqrst"[int(c)] for c in str(10_000 + 7 * k)) for k in range(1_500)]
    model = language.fit(docs_frame(spark, texts + texts[:40] * 5), F.lit(True), centroids=1)
    vectors = language.weigh(np.stack([language.gram_counts(language.letters(t)) for t in texts]), model.idf)
    assert np.abs(model.vectors[0] - language.unit(np.unique(vectors, axis=0).sum(axis=0))).max() < 1e-5


def test_foreign_text_is_rejected(spark):
    docs = docs_frame(spark, [f"the quick brown fox number {k} jumps over the lazy dog near the river bank" for k in range(40)])
    model = language.fit(docs, F.lit(True))
    _, _, rejected = model.predict(["the lazy dog jumps over the river", "жзл щшч фюэ цъы", "a"])
    assert rejected.tolist()[:2] == [False, True]


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_languages_not_learned_are_rejected(spark, left_out):
    """Texts in Latin letters too; hardly any text of a learned language goes with them."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id % 4 = 0 AND length(text) > 200")
    model = language.fit(docs.where(F.col("lang") != left_out), language.learnable())
    found = language.identify(docs.where(~language.learnable()), model, ["doc_id", "lang"])
    share = {r[0]: r[1] for r in found.groupBy(F.col("lang") == left_out).agg(F.avg(F.col("_rejected").cast("double"))).collect()}
    assert share[True] > 0.9 and share[False] < 0.02, share


def test_a_sentence_of_a_language_not_learned_is_rejected(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id % 4 = 0")
    model = language.fit(docs, language.learnable())
    assert model.predict(["Talvella järven jää oli niin paksua, että kylän lapset luistelivat koulun jälkeen iltaan asti."])[2].all()


def test_broken_tags_take_linear_time():
    for unit in ("<a x='>'y\" ", '<a "', "<a b='\"' > ' ", "<li></li>"):
        start = "<li><ul>" + "<div>" * 20_000
        took = []
        for size in (1 << 19, 1 << 21):
            begun = time.process_time()
            blocks(start + unit * (size // len(unit)))
            took.append(time.process_time() - begun)
        assert took[1] < 10 * took[0] + 1, unit


def test_tags_end_past_quoted_brackets_unless_a_quote_stays_open():
    many = " ".join(f"data-{k}='>'" for k in range(40))
    assert [b.text for b in blocks(f"<p {many} title=\"a>b\">one<p>two")] == ["one", "two"]
    assert [b.text for b in blocks("<p>one <a href='x>two</a> three")] == ["one two three"]


def test_blocks_are_labelled_on_new_pages():
    model = extraction.train(labelled())
    right = total = 0
    for bs, ys in labelled(150, seed=91):
        shown = [(b, y) for b, y in zip(bs, ys, strict=True) if not b.hidden]
        right += sum(p == y for p, (_, y) in zip(model.decode([b for b, _ in shown]), shown, strict=True))
        total += len(shown)
    assert right > 0.99 * total


def test_viterbi_finds_the_best_sequence():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 7))
        names = [f"t{k}" for k in range(n)]
        sequence = [blocks(f"<p>{'x' * (k + 1)}")[0]._replace(tag=t, around=frozenset(), near=frozenset()) for k, t in enumerate(names)]
        model = extraction.ChainField({f"own:{t}": float(r.normal() * 2) for t in names}, r.normal(size=2), r.normal(size=(2, 2)))

        def value(labels, model=model, sequence=sequence):
            total = model.first[labels[0]] + sum(model.pair[a, b] for a, b in zip(labels, labels[1:], strict=False))
            return total + sum(model.lean(b) for b, y in zip(sequence, labels, strict=True) if y)

        every = [[m >> k & 1 for k in range(n)] for m in range(1 << n)]
        assert np.isclose(value(model.decode(sequence)), max(map(value, every)))


def test_main_text_of_pages(spark):
    article = "<article><h1>A &amp; B</h1><p><b>First\n  line.<br><p>Second&nbsp;line</p></article>"
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        '<nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>'
        f"{article}<section class='comments'><p>I think it is a fine text.</p></section><footer>&copy; site</footer></body></html>"
    )
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p"), (5, "u", "<div>" * 20_000 + "deep"), (6, "u", "plain < text & more")]
    pages = spark.createDataFrame([r + ("x", 0.1) for r in rows], "page_id long, url string, html string, text string, score double")
    got = extraction.extract(pages).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.n_chars == len(x.text)
        if x.page_id == 1:
            assert x.text == "A & B\nFirst line.\nSecond line"
    assert extraction.extract(pages.limit(0)).count() == 0


def test_beginnings_are_counted_in_the_bins_they_use():
    r = np.random.default_rng(7)
    for n in (8, 9, 15, 16, 17, 100, 2047, 2048):
        words = language.letters("".join(r.choice(list("abcdeé 日"), n)) + "x")[:n]
        used, counts = language.cut_counts(words)
        ends = [e - 1 for e in (8, *language.LENGTHS) if len(words) >= e]
        want = np.stack([language.gram_counts(words[:e] + " ") for e in ends])
        whole = np.zeros_like(want)
        whole[:, used] = counts
        assert (whole == want).all() and len(used) <= 3 * n + 3


def test_places_and_logs_of_packed_counts():
    r = np.random.default_rng(8)
    packed = r.integers(0, 256, 3000, dtype=np.uint8) * (r.random(3000) < 0.3)
    assert (language.places_of_bits(packed.astype(np.uint8)) == np.flatnonzero(np.unpackbits(packed.astype(np.uint8)))).all()
    idf = 1 + r.random(language.BINS)
    texts = [language.letters(t) for t in ("a" * 3000, "ab cd", "é" * 255, "aé " * 256)]
    counts = [language.gram_counts(t) for t in texts]
    kinds = [np.uint8 if c.max() < 256 else "<u4" for c in counts]
    batch = pa.RecordBatch.from_pydict({"bits": [np.packbits(c > 0).tobytes() for c in counts], "counts": [c[c > 0].astype(k).tobytes() for c, k in zip(counts, kinds, strict=True)]})
    row, place, v = language.vectors_of(batch, idf)
    found = np.zeros((len(texts), language.BINS), np.float32)
    found[row, place] = v
    assert np.allclose(found, language.weigh(counts, idf), atol=1e-6)


def test_letters_are_those_of_the_plain_form():
    def plain(text):
        words = re.sub(r"[\W\d_]+", " ", text.lower()).strip()
        return f" {words} " if any(c.isalpha() for c in words) else ""

    r = np.random.default_rng(9)
    texts = [chr(k) for k in range(0x250)]
    for top in (0x80, 0x100, 0x250, 0x3100):
        texts += ["".join(r.choice([" ", "\n", "_", "a", "ß", "É", "½", "7", chr(r.integers(top))], 20)) for _ in range(500)]
    texts += ["ΟΔΟΣ ΟΔΟΣ", "İstanbul", "“Déjà – vu”", "\x1c\x85\xa0\xad", "e\u0301t\u00e9", "K\u212a"]
    assert [language.letters(t) for t in texts] == [plain(t) for t in texts]
    for long in ("Größe, ça déjà vu: 7 años; the quick brown fox. " * 400, "“Größe”, ça déjà vu – 7 años; наши слова. " * 400):
        took = []
        for work in (plain, language.letters):
            work(long)
            begun = time.process_time()
            for _ in range(100):
                work(long)
            took.append(time.process_time() - begun)
        assert took[1] < 0.7 * took[0], took


def test_counts_are_packed_in_the_least_width():
    for top, width in ((1, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4)):
        counts = np.array([1, top, 3, 7])
        packed = language.packed_counts(counts)
        assert len(packed) == 4 * width and (language.unpacked_counts(packed, 4) == counts).all()
    for counts in (np.array([1, 8_191]), np.array([1, 8_192, 1 << 20])):
        assert (language.logs_of(counts) == np.log1p(counts)).all()
