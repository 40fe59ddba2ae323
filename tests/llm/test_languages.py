import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import languages as lg

SAMPLES = {
    "en": "the house stands near the river and the children are playing with the dog in the garden while the rain falls",
    "de": "das Haus steht am Fluss und die Kinder spielen mit dem Hund im Garten während der Regen auf die Straße fällt",
    "fr": "la maison se trouve près de la rivière et les enfants jouent avec le chien dans le jardin pendant que la pluie tombe",
    "ru": "дом стоит у реки и дети играют с собакой в саду пока идёт дождь и ветер шумит над крышей",
    "ja": "家は川の近くにあり、子供たちは雨が降るあいだ庭で犬と遊んでいます。",
}


@pytest.fixture(scope="module")
def profiles():
    return lg.fitted([(k, v) for k, v in SAMPLES.items() for _ in range(3)])


@pytest.mark.parametrize("text,lang", [("the dog stands near the garden", "en"), ("die Kinder stehen am Fluss", "de"), ("les enfants dans la maison", "fr"), ("дети у реки", "ru"), ("犬は家の近くにいます", "ja")])
def test_whole_texts(profiles, text, lang):
    [[(no, found, sure)]] = profiles.judged([text])
    assert (no, found) == (0, lang) and 0.5 <= sure <= 1


def test_mixed_text_has_its_paragraphs(profiles):
    rows = profiles.judged([SAMPLES["en"] + "\n\n" + SAMPLES["de"] + "\n \t\n12\n\n" + SAMPLES["en"]])[0]
    assert [(n, lang) for n, lang, _ in rows] == [(0, "en"), (1, "en"), (2, "de"), (3, "en"), (4, "en")]


def test_texts_without_language(profiles):
    assert profiles.judged([None, "", " \n", "12/7 = 1.7", "👍"]) == [[]] * 5


def test_runs_of_a_letter_count_little(profiles):
    assert profiles.judged(["the dog is near the house " + "a" * 5000])[0][0][1] == "en"


def test_batches_do_not_matter(profiles):
    texts = [SAMPLES["de"], "", SAMPLES["ja"], SAMPLES["en"] * 50]
    together, _ = profiles.cosines(texts)
    alone = np.vstack([profiles.cosines([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_table_of_products_equals_the_bundle(profiles):
    """The look-up gives what bundling a text's bound vectors and multiplying gives."""
    text = SAMPLES["fr"]
    [(_, ids, _)] = list(lg.trigrams([text]))
    bundle = lg.bound(ids).astype(np.float64).sum(0)
    counts = np.unique(ids, return_counts=True)[1]
    want = profiles.prototypes @ bundle / (np.sqrt(lg.DIMENSION) * np.sqrt((counts.astype(float) ** 2).sum()))
    assert np.allclose(profiles.cosines([text])[0][0], want, atol=1e-4)
    assert abs(np.linalg.norm(bundle) / np.sqrt(lg.DIMENSION * (counts.astype(float) ** 2).sum()) - 1) < 0.2


def test_labels(spark):
    labels = ["en", " EN ", "en_GB", "English", "eng", "de-AT", "Deutsch", "xx", "und", "", None, "日本語", "pt-BR"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, lang string")
    got = [r.c for r in df.orderBy("i").select(lg.label_code(F.col("lang")).alias("c")).collect()]
    assert got == ["en"] * 5 + ["de", "de"] + [None] * 4 + ["ja", "pt"]


def test_rows(spark, profiles):
    df = spark.createDataFrame([(1, None, "a"), (2, SAMPLES["de"], "b"), (2, SAMPLES["de"], "b")], "id long, body string, label string")
    rows = lg.languages(df, "id", "body", profiles, "label").collect()
    assert [(r.row_id, r.para_no, r.lang, r.label) for r in rows] == [(2, 0, "de", "b")] * 2
    assert lg.languages(df.limit(0), "id", "body", profiles).count() == 0


def test_held_out_accuracy(spark, data):
    """Prototypes of the labelled documents name the language of other labelled documents."""
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text", lg.label_code(F.col("lang")).alias("label"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    fit = lg.fitted(lg.training_rows(docs.filter(~held_out), "doc_id", "text", F.col("label")))
    test = docs.filter(held_out & F.col("label").isNotNull())
    rows = lg.languages(test, "doc_id", "text", fit, "label").filter("para_no = 0").collect()
    # some labels are wrong on purpose
    assert len(rows) > 100 and sum(r.lang == r.label for r in rows) / len(rows) > 0.9


def test_query_without_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert lg.p9_found(spark, str(tmp_path)).count() == 0


def test_a_language_that_labels_bring(spark, tmp_path):
    """Documents labelled in a fourteenth language get its prototype; a label too rare for one is let stand."""
    finnish = ["tämä on suomenkielinen teksti joka kertoo pitkästä talvesta ja lyhyestä kesästä järven rannalla", "vanha talo seisoo mäellä ja sen ikkunat näkyvät kauas merelle kun ilta tulee", "lapset juoksevat pihalla ja koira haukkuu heidän perässään koko aamun ajan"]
    english = ["this is a text that tells of the long winter and the short summer by the lake", "the old house stands on the hill and its windows are seen from far out at sea", "children run in the yard and the dog barks after them all through the morning"]
    rows = [(i, finnish[i % 3] + f" {i}", "fi") for i in range(30)] + [(100 + i, english[i % 3] + f" {i}", "en") for i in range(30)] + [(200, finnish[0], None), (201, english[1], "fi"), (202, finnish[1], "et")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in lg.p9_found(spark, str(tmp_path)).collect()) == [(200, 0, "fi"), (201, 0, "en")]
