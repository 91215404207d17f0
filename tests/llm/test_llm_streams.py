"""Language, scores, packing, files, mixing and the pipeline against brute force, round trips and held-out accuracy."""
import base64
import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from refaudit.llm import language, mixing, packing, ppm, token_files, warc
from refaudit.llm.common import global_index, shared_folder

SF = "/root/testdata/sf0.001"
WORDS = {"en": "the house stands near water while people walk through green fields every morning", "fr": "le petit chat mange une souris dans la grande maison pendant que nous dormons",
         "de": "der kleine Hund läuft durch den Wald und sucht seine Freunde am frühen Morgen", "es": "el perro corre por la calle mientras los niños juegan con una pelota roja"}


def sentences(lang, n, seed):
    rng, words = np.random.default_rng(seed), WORDS[lang].split()
    return [" ".join(rng.choice(words, 12)) for _ in range(n)]


@pytest.fixture(scope="module")
def speech(spark):
    rows = [(i * 4 + j, t, lang, f"www.site{j}.example.{lang}" if i % 2 else None, "z") for j, lang in enumerate(WORDS) for i, t in enumerate(sentences(lang, 40, j))]
    rows += [(900, None, "en", "x.en", "z"), (901, "", "en", None, "z"), (902, "12 34 !!", "en", "x.en", "z"), (903, "xqzkw vbnmq zxqwk jjkqx " * 40, None, None, "z"), (904, rows[0][1], "zz-ZZ-!", None, "z"),
             (None, rows[0][1], None, None, "z"), (0, *rows[0][1:]), (905, (WORDS["de"] + " ") * 4000, None, None, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _host string").repartition(3)


@pytest.mark.parametrize("few", [1000, 0])
def test_language(speech, few):
    """Priors by broadcast and by salted join."""
    out = language.identify(speech, F.col("text"), F.col("lang"), F.col("source"), few_hosts=few)
    assert out.columns == [*speech.columns, "language", "probability", "grams", "accepted"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == speech.count()
    assert all(r["language"] == r["lang"] and r["accepted"] for i, r in rows.items() if i is not None and i < 900)
    assert all(rows[i]["language"] is None and not rows[i]["accepted"] for i in (900, 901, 902))
    assert not rows[903]["accepted"] and rows[904]["language"] == "en" and rows[None]["language"] == "en" and rows[905]["language"] == "de"


def test_language_held_out(speech, spark):
    """Wrong and missing declarations on new texts: the text decides, and the host where the text says little."""
    new = [(i, t, wrong, "www.site0.example.en") for j, lang in enumerate(WORDS) for i, (t, wrong) in enumerate(zip(sentences(lang, 20, 50 + j), ["fr", None] * 10, strict=True))]
    both = speech.select("doc_id", "text", "lang", "source").withColumn("label", F.col("lang")).unionByName(spark.createDataFrame(new, "doc_id long, text string, lang string, source string").withColumn("label", F.lit(None).cast("string")))
    got = language.identify(both, F.col("text"), F.col("lang"), F.col("source"), F.col("label")).filter("label IS NULL AND source = 'www.site0.example.en'").collect()
    truth = {t: lang for j, lang in enumerate(WORDS) for t in sentences(lang, 20, 50 + j)}
    assert np.mean([r["language"] == truth[r["text"]] for r in got]) > 0.97
    evidence = spark.createDataFrame([("en", "example.en", "a.example.en", 0, 90), ("en", "example.en", "b.example.en", 1, 1), ("fr", "x.fr", "x.fr", 1, 50)], "_suffix string, _domain string, _host string, best int, n long")
    priors, world = language.host_priors(evidence, 3)
    shares = {r["_host"]: r["prior"] for r in priors.collect()}
    assert all(sum(p) == pytest.approx(1) for p in [*shares.values(), world])
    assert shares["b.example.en"][0] > shares["x.fr"][0] and shares["b.example.en"][1] > shares["a.example.en"][1]


def test_language_empty_and_markup(speech, spark):
    assert language.known_language(speech.limit(0)).collect() == []
    pages = spark.createDataFrame([("<!doctype html><HTML class=x lang='de-AT'><p>", "https://Blog.Example.DE/a"), ("<p>", None), (None, "no address")], "html string, url string")
    got = pages.select(language.declared_language(language.markup_language(F.col("html"))), language.address_host(F.col("url"))).collect()
    assert got[0][:] == ("de", "blog.example.de") and got[1][:] == (None, None) and got[2][0] is None


def test_language_without_labels(speech):
    """No text can be told from another: ties are no evidence for anybody."""
    out = language.identify(speech, F.col("text"), F.col("lang"), F.col("source"), F.lit(None).cast("string")).collect()
    assert len(out) == speech.count() and not any(r["accepted"] for r in out)


def test_declarations_behind_long_preambles(spark):
    far = "<!-- " + "x" * 70_000 + " --><html " + "data-x='y' " * 500 + 'xml:lang = "de">'
    pages = spark.createDataFrame([(far,), ("<html" * 20_000 + " lang=fr",), ("<p lang=en>",), ("<html><p lang=en>",)], "html string")
    assert [r[0] for r in pages.select(language.markup_language(F.col("html"))).collect()] == ["de", None, None, None]


def brute_ppm(texts, order=ppm.ORDER):
    trie, counts = collections.defaultdict(collections.Counter), collections.Counter()
    for i, t in texts:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split() + [b""])

    def steps(w):
        y = b" " + w + b" "
        return [(y[max(0, p - order):p], y[p]) for p in range(1, len(y))] if w else [(b" ", 256)]
    for w, c in counts.items():
        for ctx, s in steps(w):
            for k in range(len(ctx) + 1):
                trie[ctx[len(ctx) - k:]][s] += c

    def log(ctx, s):
        out, total = set(), 0.0
        for k in range(len(ctx), -1, -1):
            left = {a: b for a, b in trie.get(ctx[len(ctx) - k:], {}).items() if a not in out}
            if left:
                T, q = sum(left.values()), len(left)
                if s in left:
                    return total + math.log((1 - q / (2 * T)) * left[s] / T)
                total += math.log(q / (2 * T))
                out |= set(left)
        return total - math.log(257 - len(out))
    return counts, log, lambda w: sum(log(*x) for x in steps(w))


TEXTS = [(1, "The cat and the hat"), (2, "a cat"), (3, None), (4, ""), (5, "the THE the zebra\xff"), (None, "the dog"), (6, "dog " * 5000 + "x" * 3000), (7, "hat cat"), (7, "hat cat"), (8, "né à"), (9, "thec"), (10, "cats hats")]


def test_scores(spark):
    df = spark.createDataFrame([(i, t, "c") for i, t in TEXTS], "doc_id long, text string, codes string").repartition(3)
    counts, _, word = brute_ppm(TEXTS)
    N, V, w = sum(counts.values()), len(counts), ppm.WEIGHT
    got = sorted(ppm.score_texts(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    for (i, t), r in zip(sorted(TEXTS, key=lambda x: (x[0] is None, x[0])), got, strict=True):
        own = collections.Counter((t or "").encode().lower().split() + [b""])
        n = sum(own.values())
        assert (r["doc_id"], r["n_tokens"], r["train_tokens"]) == (i, n, N)
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1) and r["n_known"] == sum(k for x, k in own.items() if counts[x])
        assert r["base_score"] == pytest.approx(sum(k * math.log10((counts[x] + .5) / (N + .5 * (V + 1))) for x, k in own.items()))
        score = math.lgamma(w) - math.lgamma(w + n)
        for x, k in own.items():
            score += math.log(w) + word(x) + sum(math.log(w * math.exp(word(x)) + j) for j in range(1, k))
        assert r["score"] == pytest.approx(score / math.log(10), rel=1e-9)
    assert ppm.score_texts(df.limit(0)).collect() == []


def test_step_probabilities_sum_to_one(spark):
    _, log, _ = brute_ppm(TEXTS)
    for ctx in (b" ", b" t", b"th", b"zz", b"", b"he cat"):
        assert sum(math.exp(log(ctx, s)) for s in range(257)) == pytest.approx(1)


def test_scores_without_training_text(spark):
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = ppm.score_texts(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    w, p = ppm.WEIGHT, (257.0 ** -3, 257.0 ** -1)
    assert row["n_known"] == 0 and row["score"] == pytest.approx(math.log10(w * p[0] / w * w * p[1] / (w + 1)))


def test_packing_plan():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([rng.integers(0, 300, 500), [512, 512, 100, 100, 1]])
    where, final = packing.pack_pieces(sizes, (128, 256, 512))
    used = np.bincount(where, sizes, len(final))
    assert (used <= final).all() and set(final) <= {128, 256, 512}
    assert all(u > max([x for x in (0, 128, 256, 512) if x < f]) or f == 128 for u, f in zip(used, final, strict=True))  # downsized
    plans = [packing._fill(np.argsort(-sizes, kind="stable"), sizes, (128, 256, 512), x, packing.bin_cost)[2] for x in (128, 256, 512)]
    assert sum(map(packing.bin_cost, final.tolist())) == min(plans)
    # the tightest open bin is taken: brute force over all open bins
    room, places = [], []
    for s in np.sort(sizes)[::-1]:
        fits = [i for i, r in enumerate(room) if r >= s and r > 0]
        if fits:
            i = min(fits, key=lambda i: room[i])
        else:
            i = len(room)
            room.append(512)
        room[i] -= s
        places.append(i)
    assert len(room) == len(packing._fill(np.argsort(-sizes, kind="stable"), sizes, (128, 256, 512), 512, packing.bin_cost)[1])


@pytest.mark.parametrize("window", [50_000, 7])
def test_packing(spark, window):
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), 1) for i in range(60)] + [(None, "w " * 1000, 1), (5, None, 1), (5, None, 1), (70, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3)
    got = packing.packed_documents(df, lengths=(64, 128), window=window).toPandas()
    bins = got.sort_values(["bin_id", "bin_start"]).groupby("bin_id")
    for _, b in bins:
        assert b["bin_length"].nunique() == 1 and b["piece_size"].sum() <= b["bin_length"].iloc[0]
        assert b["bin_start"].tolist() == (b["piece_size"].cumsum() - b["piece_size"]).tolist()
    words = sum(len((t or "").split()) + 1 for _, t, _ in rows)
    assert got["piece_size"].sum() == words and got["doc_id"].isna().sum() == 8  # 1,001 places in pieces of 128
    assert packing.packed_documents(df.limit(0)).collect() == []


def test_token_files(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = P.path(token_files.VOCABULARY)
    tk = Tokenizer.from_file(path)
    odd = "Don't STOP the\x1cmusic now é ́x 12,000€ <|endoftext|>ab <|ENDOFTEXT|> ﬁne"
    rows = [(3, odd), (1, None), (2, ""), (9, "long words " * 3000), (4, "The cat sat."), (4, "again"), (None, "first"), (-5, "minus \t\n\x0b\x0c\r end")]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, file string").repartition(3)
    folder = str(tmp_path / "t")
    index = token_files.write_tokens(df, folder, path, length=16)
    got = sorted(token_files.read_checksums(index, folder).collect(), key=lambda r: r["start"])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r["doc_id"] for r in got] == [w[0] for w in want] and sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    places = index.toPandas()
    name = places["file"].iloc[0]
    reader = token_files.SequenceReader(f"{folder}/{name}")
    ids, mask = reader.sequence(0)
    total = int(places[places["file"] == name]["n_tokens"].sum())
    assert len(ids) == len(mask) == 16 and mask.sum() == min(16, total) and ids[0] == next(reader.ids(0, 1))[0]
    last, mask = reader.sequence((total - 1) // 16)
    assert mask.sum() == (total - 1) % 16 + 1 and not last[~mask].any()
    assert token_files.read_checksums(token_files.write_tokens(df.limit(0), folder, path), folder).collect() == []


def test_bundles(spark, tmp_path):
    big = "<p>" + "é" * 400_000
    rows = [(5, "u5", "<a>"), (2, "u\r\n2", "<a>"), (7, None, None), (8, "u8", ""), (9, "u9", big), (1, "u1", big + "x"), (None, "n", "<a>"), (11, "e", "a\r\n\r\nWARC/1.1\r\n"), (2, "u2", "<a>"), (12, "x", "\x00\n")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, refers_to string").repartition(2)
    folder = str(tmp_path / "w")
    index = warc.write_bundles(df, folder, frame_bytes=64)
    got = warc.read_bundles(index, folder).collect()
    key = lambda r: (str(r[0]), r[1], r[2], r[3], str(r[4]))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in rows]
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    for r in index.collect():  # each record by frame and offset
        reader = warc.BundleReader(f"{folder}/{r['file']}")
        headers, block = reader.record(r["frame"], r["offset"])
        assert headers["warc-record-id"] == r["record_id"] and len(block) == int(headers["content-length"])
        raw = open(f"{folder}/{r['file']}", "rb").read()
        assert struct.unpack("<IBI", raw[-9:]) == (len(reader.sizes), 0, warc.SEEKABLE)
        reader.close()
    none = warc.write_bundles(df, str(tmp_path / "v"), min_bytes=3)
    types = warc.read_bundles(none, str(tmp_path / "v")).filter("payload_bytes < 3").select("record_type").distinct().collect()
    assert [t[0] for t in types] == ["response"]
    assert warc.read_bundles(warc.write_bundles(df.limit(0), folder), folder).collect() == []


def test_every_file_is_read_by_a_task_of_its_own(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(60)], "page_id long, url string, html string").repartition(6)
    records = warc.read_bundles(warc.write_bundles(df, str(tmp_path / "w")), str(tmp_path / "w"))
    tasks = records.groupBy(F.spark_partition_id()).agg(F.count_distinct("file").alias("files")).collect()
    assert records.count() == 60 and len(tasks) == 6 and all(r["files"] == 1 for r in tasks)


def brute_targets(sizes, weights=mixing.WEIGHTS):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rate = (total - sum(3 * sizes[s] for s in capped)) / max(sum(weight[s] for s in sizes if s not in capped), 1e-300)
        over = {s for s in sizes if s not in capped and rate * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else rate * weight[s] for s in sizes}
        capped |= over


def test_mixing(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "B", "é", None, "tiny", "z"][int(rng.choice(6, p=[.5, .2, .1, .1, .02, .08]))], 0) for i in range(600)]
    rows += [(700, None, "only null", 0), (701, "x", "one", 0), (0, *rows[0][1:]), (None, "w w w", "a", 0), *[(800 + i, "same copy of a text", "a", 0) for i in range(100)], (990, "w " * 3000, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _rank int").repartition(4)
    out = mixing.mix_sources(df, salts=4)
    assert out.columns == [*df.columns, "size", "source_size", "target", "copies", "taken"]
    got = out.toPandas()
    again = mixing.mix_sources(df.repartition(7), salts=4).toPandas()
    sort = lambda d: d.fillna({"doc_id": -1}).sort_values(["doc_id", "taken"])[["doc_id", "taken"]].to_numpy().tolist()
    assert sort(got) == sort(again) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].between(0, 3).all()
    for s, d in got.groupby(got["source"].fillna("no source")):
        s = None if s == "no source" else s
        assert d["source_size"].iloc[0] == sizes[s] and d["target"].iloc[0] == pytest.approx(want[s])
        assert abs(d["taken"].sum() - want[s]) <= max(3, 0.01 * want[s])
    mix = mixing.mixed(df, salts=4)
    assert mix.schema == df.schema and mix.count() == got["copies"].sum()
    assert mixing.mix_sources(df.limit(0)).collect() == []


def test_mixing_does_not_shuffle_texts(spark):
    """Who drops the text of the mix shuffles sizes and ids only, also without broadcast joins."""
    df = spark.createDataFrame([(i, "word " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.mix_sources(df, salts=4).select("doc_id", "size", "taken")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Join" in plan and "in1" not in plan  # the text under its inner name


def test_mixing_without_ids(spark):
    rows = [(None, f"w{i} " + "w " * (i % 4), "ab"[i % 5 == 0]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [mixing.mix_sources(df.repartition(n), salts=8).select("text", "taken").collect() for n in (2, 7)]
    assert sorted(runs[0]) == sorted(runs[1]) and len(runs[0]) == 200


def test_unmet_targets_are_reported(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    sizes = spark.createDataFrame([("a", 10, 20), ("a", 200, 3)], "_source string, size long, docs long")
    with pytest.raises(RuntimeError, match="target"):
        mixing.tilt(sizes, spark.createDataFrame([("a", 400.0, 200)], "_source string, target double, largest long"))


def test_tilt_meets_targets_before_rounding(spark):
    sizes = spark.createDataFrame([(s, n, c) for s in "ab" for n, c in ((1, 50), (10, 20), (200, 3))], "_source string, size long, docs long")
    targets = spark.createDataFrame([("a", 400.0, 200), ("b", 2500.0, 200)], "_source string, target double, largest long")
    got = mixing.tilt(sizes, targets).groupBy("_source").agg(F.sum(F.col("docs") * F.col("size") * F.col("_rate")).alias("t")).collect()
    assert {r[0]: round(r[1], 1) for r in got} == {"a": 400.0, "b": 2500.0}


def test_global_index(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(5)
    assert all(r["v"] == r["i"] for r in global_index(df, [F.col("v")], "i", "t").collect())


def test_pipeline(spark):
    """The stages in order, each on all that its predecessor kept, against the operators' own brute-force properties."""
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        path = shared_folder(spark, "test")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        if name != "packing":
            assert docs.schema == before.schema
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert kept["language"].count() == len(texts)
    plain = lambda t: "".join(t.encode().decode().translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
    left = [plain(r[0]) for r in kept["exact_dedup"].select("text").collect()]
    assert len(left) == len(set(left)) == len({plain(t) for t in texts})
    assert kept["near_dedup"].exceptAll(kept["exact_dedup"]).count() == 0
    words = kept["mixing"].select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum(F.col("n") + 1)).first()[0]
    assert kept["packing"].agg(F.sum("piece_size")).first()[0] == words
    total = kept["near_dedup"].select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(words - kept["mixing"].count() - total) < 0.05 * total
    assert isinstance(pd.DataFrame(corpus_pipeline.run(spark, SF).limit(3).toPandas()), pd.DataFrame)


def test_registered():
    from __spark_entry__ import oracle_sql, queries
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2:3].isdigit()) == list(range(1, 14)) and "pipeline" in queries()
    assert {"op2_sharding", "op3_exact_dedup", "op8_warc"} <= set(oracle_sql())
