"""The two classifiers: accuracy on held-out rows, gradients, and odd inputs."""

import random
import zlib

import numpy as np

from lorespan.llm import quality_mil, toxicity

WORDS = ["lorem", "ipsum", "dolor", "amet", "sit", "magna", "erat", "quis", "nunc", "velit", "porta", "justo"]


def corpus(spark, n=400):
    rng, docs, labels = random.Random(9), [], []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(10, 80))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["dreadfulness", "dreadful", "dreadfully", "horridly", "horrid"])
        docs.append((i, " ".join(words), 0.5, "en"))
        labels.append((i, 0 if bad else 1, int(bad)))
    docs += [(1000, None, 0.5, "en"), (1001, "", 0.5, "en"), (None, "lorem ipsum", 0.5, "en"), (3, "repeated id", 0.5, "en"), (1002, "lorem " * 20000, 0.5, "en"), (1003, "lorem dreadfull ipsum dolor amet sit magna", 0.5, "en")]
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, y string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_carries_over_to_misspellings(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit_toxicity(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.9
    assert got[1003] > 0.5 > got[1002] and got[1000] == got[1001] < 0.5
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {3} == {i for i, s in got.items() if s < 0.5} - {3}  # id 3 has two texts
    again = toxicity.fit_toxicity(docs, labels)
    assert again.bias == model.bias and (again.amounts == model.amounts).all()


def test_classifiers_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 8)
    for some, want in ((labels.limit(0), {0.5}), (labels.filter("toxic = 0"), None)):
        scores = {r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, some)).collect()}
        assert scores == want if want else max(scores) < 0.5
        scores = {r.score for r in quality_mil.score_quality(docs, quality_mil.fit_quality(docs, some)).collect()}
        assert scores == want if want else min(scores) > 0.5
    assert toxicity.score_toxicity(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), labels)).count() == 0
    assert quality_mil.score_quality(docs.limit(0), quality_mil.fit_quality(docs.limit(0), labels)).count() == 0


def test_quality_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(rng.integers(1, 5), quality_mil.N_FEATURES)) for _ in range(12)]
    y = np.array([0, 1] * 6, dtype=float)
    model = quality_mil.train(bags, y, epochs=3)
    doc = np.repeat(np.arange(12), [len(b) for b in bags])
    loss = lambda: -np.mean(y * np.log(s := np.clip(model.scores(bags), 1e-12, 1 - 1e-12)) + (1 - y) * np.log(1 - s))
    before, early = loss(), model
    model = quality_mil.train(bags, y, epochs=60)
    assert loss() < before
    attention = early.forward(np.concatenate(bags), doc, 12)[4]
    assert np.allclose(np.bincount(doc, weights=attention), 1)


def numeric(loss, array, step=1e-5):
    out = np.zeros_like(array)
    for i in np.ndindex(array.shape):
        kept = array[i]
        array[i] = kept + step
        up = loss()
        array[i] = kept - step
        out[i] = (up - loss()) / (2 * step)
        array[i] = kept
    return out


def test_quality_gradients():
    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(k, quality_mil.N_FEATURES)) for k in (1, 3, 2, 4)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    model = quality_mil.train(bags, y, epochs=2)
    x, doc, weight = np.concatenate(bags), np.repeat(np.arange(4), [1, 3, 2, 4]), np.full(4, 0.25)
    _, grads = model.gradients(x, doc, y, weight)
    for name, value in model.params.items():
        part = value[:6] if name == "we" else value  # a view: the encoder has many rows
        want = numeric(lambda: model.gradients(x, doc, y, weight)[0], part)
        assert np.allclose(grads[name][: len(part)], want, atol=1e-7), name


def test_toxicity_gradients():
    rng = np.random.default_rng(5)
    params = [rng.normal(size=(7, toxicity.DIM)), rng.normal(size=(toxicity.DIM, 2)), np.array([0.3])]
    doc, rows, weights = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 3, 6, 1, 3, 5]), rng.normal(size=6)
    y = np.array([1.0, 0.0, 1.0])
    loss, grads = toxicity.gradients(*params, doc, rows, weights, y)
    for p, g in zip(params, grads, strict=True):
        assert np.allclose(g, numeric(lambda: toxicity.gradients(*params, doc, rows, weights, y)[0], p), atol=1e-7)


def test_passages_carry_words():
    one, two = quality_mil.passages("alpha beta gamma"), quality_mil.passages("gamma beta alpha")
    assert one.shape == (1, quality_mil.N_FEATURES) and not np.allclose(one, two)  # pairs tell the order
    long = quality_mil.passages(" ".join(f"w{i}" for i in range(250)))
    assert len(long) == 3 and np.allclose(long[0, quality_mil.N_MEASURES :] * np.sqrt(200) % 1, 0)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(40, 260))]
        if i % 3 == 0:
            at = rng.randrange(max(1, len(words) - 30))
            words[at : at + 30] = [rng.choice(["BUY!!", "NOW!!"])] * 30
        docs.append((i, " ".join(words), i % 7))
        labels.append((i, int(i % 3 != 0)))
    docs += [(1000, None, 0), (1001, "", 0), (None, "x", 0), (1002, "word " * 30000, 0)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, score long"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_mil.fit_quality(docs, labels)
    got = {r.doc_id: r.score for r in quality_mil.score_quality(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i % 3 != 0) for i in held]) > 0.9
    assert got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())


def test_a_worker_remembers_little_of_toxicity(spark, monkeypatch):
    """Check of the pipeline, round 3: words of several operators added up in a worker, beside batches of 32 MB and rows that held their text twice."""
    import public_tokenizers

    from lorespan.llm import common, encoding

    model = toxicity.ToxicityModel(np.arange(toxicity.BUCKETS, dtype=np.float32), 0.0)
    encoding.encoder(common.read_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    memo = toxicity._memo(model)
    assert toxicity._memo(model) is memo and list(common._remembered) == [("toxicity", model.key)]
    monkeypatch.setattr(toxicity, "CACHE_ENTRIES", 20)
    words = [f"word{i * i % 37}" for i in range(300)]
    assert [memo[w] for w in words] == [model.word(w) for w in words]
    assert len(memo) + len(memo.aside) <= 20
    docs = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "doc_id long, text string, row string")
    kept = toxicity.remove_toxic(docs, toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), -1.0))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    assert sorted(map(tuple, kept.collect())) == [(1, "a", "x"), (2, None, "y")]


def test_stages_of_the_pipeline_leave_little_behind(spark):
    """Check of the pipeline, round 3: the words of the toxicity stage stayed beside the sets of the next one, and its batches of 32 MB."""
    import public_tokenizers

    from lorespan.llm import common, encoding, jaccard_join, packing

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"word{i} and word{i + 1} " * 9) for i in range(40)], "doc_id long, text string").coalesce(1)

    def left(batches):
        batches = list(batches)
        toxicity._memo(toxicity.ToxicityModel(np.zeros(toxicity.BUCKETS, np.float32), 0.0), 20)["word"]
        before = len(common._remembered)
        jaccard_rows = list(cut(iter(batches)))
        assert jaccard_rows and (before, len(common._remembered)) == (1, 0)
        return iter(batches)

    class Rows:  # stands for a frame, to get at the function that the tasks run
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    cut = jaccard_join.signature_rows(Rows(), "text", 5, 80)
    left(docs.select("text").toArrow().to_batches())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    few, many = (sorted(map(tuple, packing.pack_documents(docs, path, 0, 64, entries=n, most=4 << 20).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for n in (3, 1000))
    assert few == many
    small = encoding.Encoder(common.read_bytes(path), 3)
    assert small.encode("a b c d e f g") == encoding.Encoder(common.read_bytes(path)).encode("a b c d e f g") and len(small.after_space) <= 3
