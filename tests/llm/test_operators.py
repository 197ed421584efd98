"""Each operator against a brute-force version or an exact round trip, on tables with odd cases, and on empty ones."""

import hashlib
import zlib

import brute
import numpy as np
import pytest
from llm_tables import as_dir, odd_rows, prose
from pyspark.sql import functions as F
from starloom.llm import bpe, licenses, linededup, media, mixing, outliers, quality, secrets, simhash, tokenfiles

public_tokenizers = pytest.importorskip("public_tokenizers")


def rows_of(df, *names):
    return sorted(([r[n] for n in names] for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(-3, 14)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return as_dir(spark, tmp_path_factory.mktemp("odd"), documents=odd, labels=labels)


@pytest.fixture(scope="session")
def empty_dir(spark, empty, tmp_path_factory):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    return as_dir(spark, tmp_path_factory.mktemp("empty"), documents=empty, labels=labels)


QUERIES = {
    "op1": outliers.op1_quality_rules, "op2": mixing.op2_mix, "op3": tokenfiles.op3_tokens, "op4": quality.op4_quality, "op5": bpe.op5_bpe,
    "op6": media.op6_media, "op7": secrets.op7_secrets, "op8": linededup.op8_line_dedup, "op9": simhash.op9_simhash, "op10": licenses.op10_licenses,
}


@pytest.mark.parametrize("name", QUERIES)
def test_empty_table_gives_empty_result(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", QUERIES)
def test_every_row_has_a_result_and_clashing_columns_do_not_matter(spark, odd_dir, clashing, tmp_path_factory, name):
    own = QUERIES[name](spark, odd_dir)
    got = rows_of(own, *own.columns)
    assert [r[0] for r in sorted(([r["doc_id"]] for r in own.collect()), key=repr)] == [k for k in sorted((r[0] for r in odd_rows()), key=lambda x: repr([x]))]
    other = as_dir(spark, tmp_path_factory.mktemp("clash"), documents=clashing, labels=spark.read.parquet(f"{odd_dir}/labels.parquet").withColumn("text", F.lit("clash")))
    again = QUERIES[name](spark, other)
    assert rows_of(again, *own.columns) == got


def test_op1_base_columns(spark, odd_dir):
    want = sorted(([r[0], *brute.rule_base(r[1]).values()] for r in odd_rows()), key=repr)
    out = outliers.op1_quality_rules(spark, odd_dir)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_op1_rejects_what_is_odd_for_its_group_and_keeps_the_rest(spark):
    rows = [(k, prose(k, 150 + k), "en", "web") for k in range(400)]
    rows += [(1000 + k, " ".join("Q#" + "XYZ" * 6 for _ in range(40)) + " " + prose(k, 30).upper(), "en", "web") for k in range(15)]
    out = outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    kept = {r["id"]: r["kept"] for r in out}
    assert sum(not kept[k] for k in range(400)) <= 2
    assert not any(kept[k] for k in kept if k >= 1000)


def test_op1_rejects_repeated_lines_and_repeated_words_alone(spark):
    import random

    rng = random.Random(6)
    lines = lambda n: [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(12)) for _ in range(n)]
    rows = [(k, "\n".join(lines(12 + k % 30)), "en", "web") for k in range(300)]
    rows += [(1000 + k, "\n".join(y for x in lines(20) for y in (f"menu{k}", x)), "en", "web") for k in range(3)]
    for k in range(3):
        again = " ".join(lines(6))
        rows.append((2000 + k, "\n".join([*lines(14), again, again]), "en", "web"))
    out = {r["id"]: r for r in outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(not r["kept"] for k, r in out.items() if k >= 1000), [(k, r["base_failed"], r["distance"]) for k, r in out.items() if k >= 1000]
    assert sum(not out[k]["kept"] for k in range(300)) <= 2
    assert any(not r["base_failed"] for k, r in out.items() if 1000 <= k < 2000) and any(not r["base_failed"] for k, r in out.items() if k >= 2000)


def test_op1_small_groups_use_wider_ones(spark):
    rows = [(k, prose(k, 150), "en", f"s{k % 40}") for k in range(200)] + [(900, prose(900, 150), "fr", "only")]
    out = outliers.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r["distance"] is not None for r in out)


def test_op2_targets_and_rows(spark, odd_dir):
    sizes = brute.groups((r[3], len(brute.words(r[1]))) for r in odd_rows())
    want = brute.targets({s: sum(v) for s, v in sizes.items()})
    out = mixing.op2_mix(spark, odd_dir).collect()
    source = brute.groups(((r[0], len(brute.words(r[1]))), r[3]) for r in odd_rows())
    for r in out:
        possible = source[r["doc_id"], r["size"]]
        assert any(r["source_size"] == sum(sizes[s]) and abs(r["target"] - want[s]) < 1e-6 for s in possible)
        assert r["taken"] in (0, r["size"], 2 * r["size"])


def test_op2_takes_near_the_target_and_reruns_agree(spark):
    rows = [(k, prose(k, 20 + k % 50), "abc"[min(k % 5, 2)]) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = brute.targets({s: sum(v) for s, v in brute.groups((r[2], len(brute.words(r[1]))) for r in rows).items()})

    def mixed(docs):
        sized = mixing.sizes(docs)
        return {(r["id"], r["copies"]): (r["source"], r["copies"] * r["size"]) for r in mixing.with_copies(sized, mixing.plan_mix(sized), "id", "source").collect()}

    first = mixed(docs)
    assert first == mixed(docs.repartition(7))
    for s in "abc":
        assert abs(sum(n for t, n in first.values() if t == s) - want[s]) <= 70


def test_op2_thresholds_are_nested(spark):
    sized = spark.createDataFrame([(k, "a", 1 + k % 3) for k in range(500)], "id long, source string, size long")
    total = sum(1 + k % 3 for k in range(500))

    def taken(share):
        targets = spark.createDataFrame([("a", total, share * total)], "source string, source_size long, target double")
        return {r["id"] for r in mixing.with_copies(sized, mixing.thresholds(sized, targets), "id", "source").where("copies > 0").collect()}

    small, large = taken(0.2), taken(0.6)
    assert small < large and len(large) > 200


def test_op2_refuses_clashing_columns(spark):
    sized = spark.createDataFrame([(1, "a", 1)], "id long, source string, size long")
    with pytest.raises(ValueError):
        mixing.with_copies(sized.withColumn("copies", F.lit(1)), mixing.plan_mix(sized), "id", "source")


def test_op3_reads_back_what_the_tokenizer_gives(spark, odd_dir):
    own = tokenfiles.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want, start, by_id = [], 0, brute.groups((r[0], r[1]) for r in odd_rows())
    got = sorted(tokenfiles.op3_tokens(spark, odd_dir).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd_rows()), key=lambda k: (k is not None, k or 0))
    for r in got:
        assert r["start"] == start
        digests = {}
        for text in by_id[r["doc_id"]]:
            ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
            digests[zlib.crc32(np.array(ids, "<u4").tobytes())] = len(ids)
        assert digests.get(r["ids_crc32"]) == r["n_tokens"]
        start += r["n_tokens"]
        want.append(r)


def test_op3_words_of_any_plain_texts_are_those_of_the_library():
    import random

    rng = random.Random(3)
    own = tokenfiles.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), 400)
    odd = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]] + ["\u20ac", "  ", "\n", "'s", "'ll", "e\u0301", "\u4e2d", "<|endoftext|>", "09"]
    plain = [c for c in odd if tokenfiles._PLAIN.fullmatch(c) and not c.startswith("<")]
    for _ in range(60):
        texts = ["".join(rng.choices(rng.choice((odd, plain)), k=rng.randint(0, 60))) for _ in range(20)]
        ids, counts = own(texts, 2)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in parts] == [[*own.own.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_op3_random_access_is_zero_copy(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 300)) for k in range(20)], "doc_id long, text string")
    manifest = tokenfiles.write_tokens(docs, f"file://{tmp_path}/tokens", public_tokenizers.path("word_bpe_49k.json"), length=64)
    total = 0
    for row in manifest.collect():
        file = tokenfiles.TokenFile(row["uri"])
        assert file.total == row["n_tokens"] and row["base"] == total
        total += file.total
        flat = np.concatenate(list(file.tokens(0, file.total)))
        n = -(-file.total // 64)
        for i in range(n):
            ids, mask = file.sequence(i)
            assert not ids.flags.owndata
            assert sum(mask.to_pylist()) == min(64, file.total - 64 * i)
            assert (ids[: sum(mask.to_pylist())] == flat[64 * i : 64 * i + 64]).all()


def test_op4_held_out_accuracy(spark, sf_dir):
    out = quality.op4_quality(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "quality", "predicted").collect()
    good, bad = [r["score"] for r in rows if r["quality"] == 1], [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    for r in out.select("doc_id", "held_out").limit(50).collect():
        assert r["held_out"] == (quality.crc_rest(r["doc_id"]) == 0)


def test_op4_needs_no_labels(spark, odd, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        where = as_dir(spark, tmp_path, documents=odd, labels=some)
        assert {0 <= r["score"] <= 1 for r in quality.op4_quality(spark, where).collect()} == {True}


def test_op4_gam_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_op4_boosting_equals_a_plain_version():
    rng = np.random.default_rng(5)
    x = np.round(rng.random((220, 3)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6) ^ (rng.random(220) < 0.1)).astype(float)
    model = quality.Gam.fit(x, y, bins=7, coarse_bins=4, rounds=9, n_pairs=2)
    plain = brute.Gam(x.tolist(), y.tolist(), bins=7, coarse_bins=4, rounds=9, n_pairs=2)
    for j in range(3):
        assert np.allclose(model.tables[j], plain.tables[j], atol=1e-9)
    assert [(i, j) for i, j, _ in model.pairs] == [(i, j) for i, j, _ in plain.pairs]
    assert np.allclose(model.score(x), [plain.score(r) for r in x.tolist()], atol=1e-9)


def test_op4_sample_is_bounded_and_the_least_by_hash(spark, monkeypatch):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    seen = {}
    monkeypatch.setattr(quality.Gam, "fit", classmethod(lambda cls, x, y, **_: seen.update(n=len(x), y=y.sum())))
    quality.fit(docs, labels, max_labels=500)
    assert seen["n"] == 500
    hashes = spark.range(9000).where(~quality.held_out_of(F.col("id"))).select("id", F.shiftrightunsigned(F.xxhash64("id"), 32).alias("h")).collect()
    least = sorted(hashes, key=lambda r: (r["h"], r["id"]))[:500]
    assert seen["y"] == sum(r["id"] % 2 for r in least)


def test_op5_equals_the_library(spark, odd_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe.tokenizer(path)
    want = []
    for r in odd_rows():
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append([r[0], len(ids), digest(",".join(map(str, ids))), digest(own.decode(ids, skip_special_tokens=False))])
    assert rows_of(bpe.op5_bpe(spark, odd_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op5_special_tokens_and_odd_splits(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe.tokenizer(path)
    texts = ["a<|endoftext|>b", "  two  spaces ", "don't we'll I'd x's", "tab\t\tnew\n\n line", "٣٤ ½ Ⅷ ᾳ", "　wide space​", "\U00010348͸x", "ẹ́", "'S 'T", "a\x1cb\x85c", "᠎", "\r\n \r\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: list(r["ids"]) for r in bpe.encode(docs, path).collect()}
    assert got == {k: own.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_op5_decode_alone_and_in_slices(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, [15496, 995, 50256], "x"), (2, None, None), (3, [], "y"), (4, [-1, 60000, 128], "z")]
    got = {r["k"]: r["text"] for r in bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>, other string"), path).collect()}
    assert got[1] == "Hello world<|endoftext|>" and got[2] == got[3] == "" and got[4] == bpe.tokenizer(path).decode([128], skip_special_tokens=False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "words": [["a"] * 5, None, ["b"] * 9, []]})
    monkeypatch.setattr(bpe, "SLICE_WORDS", 6)
    assert [b.column(0).to_pylist() for b in bpe._slices(batch)] == [[1, 2], [3], [4]]


def test_op6_round_trip(spark, odd_dir):
    seen = {}
    for r, row in zip(rows_of(media.op6_media(spark, odd_dir), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), [None] * 99, strict=False):
        seen.setdefault(r[0], []).append(r)
    for key, texts in brute.groups((r[0], r[1]) for r in odd_rows()).items():
        want = []
        for t in texts:
            payload, n = media.payload_of(t)
            assert len(payload) % 64 == 0 and len(payload) >= max(64, n) and payload[:n] == (t or "").encode()
            stored = media.to_wav(payload)
            want.append([n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest()])
        assert sorted(r[1:7] for r in seen[key]) == sorted(want)


def test_op6_parts():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    half = media.resample(tone, 16000, 8000)
    assert len(half) == 8000
    assert np.abs(half[100:-100] - np.sin(2 * np.pi * 440 * np.arange(8000) / 8000)[100:-100]).max() < 0.02
    assert media.segments(np.array([0, 5, 9, 6, 5, 3, 9, 1.0]), high=8, low=4) == [(2, 5), (6, 7)]
    tensors, spans, _ = media.audio_features(media.to_wav(bytes(64)))
    assert tensors.shape[1:] == (media.FRAMES, media.MELS) and spans[0][0] == 0
    assert media.tensor_array(tensors).to_numpy_ndarray().shape == tensors.shape


def test_op6_blocks_give_the_features_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    payload = rng.integers(0, 256, 2 * media.BLOCK + 5 * 64, dtype=np.uint8)
    payload[media.BLOCK - 3000 : media.BLOCK + 3000] //= 8
    for rate in (media.RATE_IN, media.RATE_OUT, 11_025):
        wav = media.to_wav(payload.tobytes(), rate)
        got = media.audio_features(wav)
        with monkeypatch.context() as m:
            m.setattr(media, "BLOCK", 1 << 40)
            want = media.audio_features(wav)
        assert got[0].shape == want[0].shape and np.abs(got[0] - want[0]).max() < 1e-3
        assert got[1] == want[1]
        assert got[2] == want[2]
    x = rng.random(5000).astype(np.float32)
    whole = media.resample(x, 11_025, 8000)
    assert np.allclose(media.resample(x, 11_025, 8000, 777, 2001), whole[777:2001], atol=1e-6)


def test_op7_base_spans(spark, odd_dir):
    want = []
    for r in odd_rows():
        kinds, digest = brute.secrets(r[1])
        want.append([r[0], kinds["assign"], kinds["access"], kinds["hex"], digest])
    assert rows_of(secrets.op7_secrets(spark, odd_dir), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)


def test_op7_automata_know_formats_and_leave_prose():
    formats = secrets.Formats(secrets.labelled_credentials())
    missed = brute.groups((kind, not any(secrets.scan(f"key is {value} here", formats))) for kind, value in secrets.labelled_credentials(200, seed=99))
    assert all(sum(v) <= len(v) * (0.08 if kind in ("random", "prefixed") else 0.01) for kind, v in missed.items()), {k: sum(v) for k, v in missed.items()}
    text = prose(3, 4000) + """ https://example.org/some/long/path-with-words.html internationalization-of-things 2024-01-02T10:00:00 1234567890123456 MAX_BUFFER_SIZE_LIMIT
    camelCaseIdentifierName AbstractSingletonProxyFactoryBean IMG_20240102_123456.jpg x86_64-linux-gnu ISBN-978-3-16-148410-0 v1.2.3-beta4 user_id_12345678 +1-249-555-1332
    B2B-SaaS-2023 https://doi.org/10.1000/xyz123 python3.11-dev COVID-19 RFC-2119 iPhone12ProMax node_modules/lodash.debounce/4.0.8 org.apache.spark.sql.catalyst.plans.logical"""
    assert secrets.scan(text, formats) == ([], [])


def test_op7_finds_formats_that_it_was_not_shown():
    import random

    rng, formats = random.Random(1), secrets.Formats(secrets.labelled_credentials())
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every, hexa = lower + lower.upper() + digit, digit + "abcdef"
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    make = {
        "gitlab": lambda: "glpat-" + pick(every, 20), "npm": lambda: "npm_" + pick(every, 36), "password": lambda: pick(every, 20), "mail": lambda: "SG." + pick(every + "_-", 22) + "." + pick(every + "_-", 43),
        "phone": lambda: "SK" + pick(hexa, 32), "shop": lambda: "shpat_" + pick(hexa, 32), "letters": lambda: "hf_" + pick(every[:52], 34), "index": lambda: "pypi-" + pick(every + "_-", 80), "long": lambda: pick(every + "+/", 86) + "==",
    }
    found = []
    for kind, f in make.items():
        own = []
        for _ in range(100):
            value = f()
            own.append(any(b > 5 and a < 5 + len(value) for x in secrets.scan(f"some {value} here", formats) for a, _, b, _ in x))
        assert sum(own) >= 80, (kind, sum(own))
        found += own
    assert sum(found) >= 0.9 * len(found)


def test_op7_states_keep_lengths_and_prefixes():
    formats = secrets.Formats(secrets.labelled_credentials())
    for kind, value in secrets.labelled_credentials(20, seed=5):
        own = formats.kinds[kind]
        assert own.bits(value) > -float("inf")
        if kind in ("github", "google", "stripe", "slack", "base64", "uuid", "key"):
            assert own.bits(value[:-1]) == own.bits(value + "a") == -float("inf")
        if kind in ("github", "google", "stripe", "slack", "jwt", "key"):
            assert own.bits("zz" + value[2:]) == -float("inf")


def test_op7_words_are_left_out_only_where_no_automaton_can_accept_them():
    import random

    rng, formats = random.Random(4), secrets.Formats(secrets.labelled_credentials())
    assert len(formats.hopeless) >= 2
    every = secrets.Formats(secrets.labelled_credentials())
    every.run = __import__("re").compile(f"(?<![{secrets._CHARS}])[{secrets._CHARS}]+")
    lower = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choices(chars, k=rng.randint(1, 70))) for chars in (lower, lower, "abcdefg", "0123456789", lower.upper(), "abcdef") for _ in range(80)]
    words += [w.capitalize() for w in words[:200]] + [w + "." for w in words[:100]] + [v for _, v in secrets.labelled_credentials(5, seed=3)]
    rng.shuffle(words)
    text = " ".join(words)
    assert secrets.scan(text, formats) == secrets.scan(text, every)
    assert any(k == "digest" for *_, k in secrets.scan(text, formats)[1])


def test_op7_finds_credentials_within_paths_and_urls():
    formats = secrets.Formats(secrets.labelled_credentials())
    fresh = secrets.labelled_credentials(60, seed=98)
    missed = []
    for kind, value in fresh:
        for before, after in (("https://maps.example.com/v1/", ""), ("docs/", "/index.html"), ("/hook/", "/")):
            text = f"see {before}{value}{after} here"
            at = len(f"see {before}")
            base, learned = secrets.scan(text, formats)
            if not any(a < at + len(value) and b > at for a, _, b, _ in base + learned):
                missed.append((kind, text))
    assert len(missed) <= len(fresh) * 3 * 4 // 100, missed[:5]
    assert {kind for kind, _ in missed} <= {"random", "prefixed"}
    google, slack = (next(v for k, v in fresh if k == kind) for kind in ("google", "slack"))
    text = f"https://maps.example.com/v1/{google}/x and /hook/{slack}"
    assert [(text[a:b], k) for a, _, b, k in secrets.scan(text, formats)[1]] == [(google, "google"), (slack, "slack")]


def test_op8_equals_brute_force(spark, tmp_path):
    import random

    rng = random.Random(4)
    lines = [prose(k, 9).replace("\n", " ") for k in range(25)] + [prose(k, 9).replace("\n", " ")[: 1 + k] for k in range(40)] + [" ", "\t", ""]
    for k in range(140):
        x = list(rng.choice(lines))
        for _ in range(rng.randint(1, 4) if len(x) > 3 else 0):
            at = rng.randrange(len(x))
            if rng.random() < 0.4:
                x[at] = rng.choice("abcxyz")
            elif rng.random() < 0.5:
                x.insert(at, rng.choice("abcxyz"))
            else:
                del x[at]
        lines.append("".join(x).strip())
    docs = spark.createDataFrame([(k, "\n".join(lines[k::17])) for k in range(17)], "doc_id long, text string")
    placed = [(d, n, x.strip()) for d in range(17) for n, x in enumerate(lines[d::17])]
    long = [p for p in placed if p[2]]
    root = brute.classes(len(long), lambda i, j: brute.same_line(long[i][2], long[j][2]))
    gone = brute.groups((long[k][0], long[k][1]) for k in range(len(long)) if root[k] != k)
    assert any(len(long[k][2]) < 32 and long[k][2] not in {p[2] for p in long[:k]} for k in range(len(long)) if root[k] != k)
    got = {r["id"]: list(r["removed"]) for r in linededup.removals(docs).collect() if r["removed"]}
    assert got == {k: sorted(v) for k, v in gone.items()}
    texts = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    for d in range(17):
        assert texts[d] == "\n".join(x for n, x in enumerate(lines[d::17]) if n not in gone.get(d, ()))
    where = as_dir(spark, tmp_path, documents=docs)
    distinct = sorted({p[2] for p in long})
    links = {x: sum(y != x and brute.same_line(x, y) for y in distinct) for x in distinct}
    want = []
    for d in range(17):
        own = [p for p in placed if p[0] == d and p[2]]
        lost = sorted(gone.get(d, ()))
        want.append([d, len(own), len(lost), ",".join(map(str, lost)), sum(links[p[2]] for p in own)])
    assert rows_of(linededup.op8_line_dedup(spark, where), "doc_id", "n_lines", "n_removed", "removed", "n_links") == sorted(want, key=repr)


def test_op8_removes_exact_repeats_of_short_lines(spark):
    docs = spark.createDataFrame([(1, "Menu\n\nthe cat\nMenu"), (2, "  Menu\t\n\nthe car\n\u00e9"), (3, "\u00e9\n}"), (4, "}\nmenu")], "doc_id long, text string")
    got = {r["id"]: (list(r["removed"]), r["n_links"]) for r in linededup.removals(docs).collect() if r["removed"]}
    assert got == {1: ([3], 0), 2: ([0], 0), 3: ([0], 0), 4: ([0], 0)}
    texts = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
    assert texts == {1: "Menu\n\nthe cat", 2: "\nthe car\n\u00e9", 3: "}", 4: "menu"}


def test_op8_links_of_a_large_group_in_small_tiles(spark):
    base = prose(1, 9).replace("\n", " ")
    lines = sorted({base[:k] + c + base[k + 1 :] for k in range(len(base)) for c in "xy"} | {base[:k] + base[k + 1 :] for k in range(0, len(base), 3)} | {prose(k, 9).replace("\n", " ") for k in range(2, 9)})
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "h long, line string")
    near = [[brute.same_line(a, b) for b in lines] for a in lines]
    want = [sum(row) - 1 for row in near]
    for tile in (10, 1024):
        found = linededup.edit_links(df, 2, tile).collect()
        counts = brute.groups((r["h"], r["n"]) for r in found)
        assert [sum(counts.get(k, [0])) for k in range(len(lines))] == want
        stars = {frozenset((r["h"], r["root"])) for r in found}
        assert brute.classes(len(lines), lambda i, j: frozenset((i, j)) in stars) == brute.classes(len(lines), lambda i, j: near[i][j])


def test_op8_banded_distance():
    import random

    rng = random.Random(1)
    pairs = [("".join(rng.choices("ab", k=rng.randint(0, 9))), "".join(rng.choices("ab", k=rng.randint(0, 9)))) for _ in range(3000)]
    for edits in (0, 1, 2, 3):
        got = linededup.within([a for a, _ in pairs], [b for _, b in pairs], edits)
        assert got.tolist() == [brute.distance(a, b) <= edits for a, b in pairs]
    pairs = [(a, b) for a, b in pairs if min(len(a), len(b)) > 3]
    got = linededup.within([a for a, _ in pairs], [b for _, b in pairs], 3, 2)
    assert got.tolist() == [brute.distance(a, b) <= min(3, len(a) // 2, len(b) // 2) for a, b in pairs]


def test_op9_equals_brute_force(spark, odd_dir):
    rows = sorted((r for r in odd_rows() if r[0] is not None), key=lambda r: r[0])
    prints = [brute.fingerprint(r[1]) for r in odd_rows()]
    everything = odd_rows()
    root = brute.classes(len(everything), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    least = {k: min((everything[i][0] for i in range(len(everything)) if root[i] == k and everything[i][0] is not None), default=None) for k in set(root)}
    want = sorted(([everything[i][0], f"{prints[i]:016x}", least[root[i]]] for i in range(len(everything))), key=repr)
    assert rows and rows_of(simhash.op9_simhash(spark, odd_dir), "doc_id", "fingerprint", "component_id") == want


def test_op9_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for x in base for _ in range(5)]
    fps = sorted({int(x) for x in base} | set(near))
    root = brute.classes(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for tile in (16, 8192):
        links = [(r["a"], r["b"]) for r in simhash.fingerprint_links(df, 3, tile).collect()]
        linked = {frozenset(x) for x in links}
        got = brute.classes(len(fps), lambda i, j: frozenset((signed[i], signed[j])) in linked)
        assert got == root


def test_op9_keeps_one_of_each_group(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    prints = [brute.wide_fingerprint(r[1]) for r in odd_rows()]
    root = brute.classes(len(prints), lambda i, j: brute.similar(prints[i], prints[j], simhash.reach(0.8)))
    got = [brute.wide_fingerprint(r["text"]) for r in kept.collect()]
    assert len(got) == len(set(root)) and {root[prints.index(x)] for x in got} == set(root)


def _similar_texts():
    import random

    rng = random.Random(8)
    texts = []
    for k in range(40):
        base = prose(k, rng.choice((30, 60, 120, 300, 900))).split()
        for share in (0.0, 0.01, 0.02, 0.04, 0.07, 0.12):
            texts.append(" ".join(w if rng.random() > share else rng.choice(("quick", "brown", "fox")) for w in base))
        texts.append(" ".join(base + prose(500 + k, len(base) // 8 + 1).split()))
        texts.append(" ".join(base[: len(base) // 2]))
    return texts + ["", " \n", "one two", "one two", "one two three"]


def test_op9_wide_links_equal_brute_force(spark):
    texts = _similar_texts()
    prints = [brute.wide_fingerprint(t) for t in texts]
    got, sizes = simhash.wide_fingerprints(__import__("pyarrow").array(texts))
    assert [(x.tolist(), n) for x, n in zip(got, sizes.tolist(), strict=True)] == prints
    root = brute.classes(len(texts), lambda i, j: brute.similar(prints[i], prints[j], simhash.reach(0.8)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in simhash.similar_documents(docs).collect()} == dict(enumerate(root))


def test_op9_wide_links_find_similar_texts_and_leave_others():
    texts = _similar_texts()
    sets, prints = [brute.shingles(t) for t in texts], [brute.wide_fingerprint(t) for t in texts]
    found, all_, wrong, apart = 0, 0, 0, 0
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            like = len(sets[i] & sets[j]) / union if union else 1.0
            linked = brute.similar(prints[i], prints[j], simhash.reach(0.8))
            if like >= 0.8:
                all_, found = all_ + 1, found + linked
            if like < 0.6:
                apart, wrong = apart + 1, wrong + linked
    assert all_ > 80 and found >= 0.9 * all_ and wrong == 0 and apart > 10_000, (found, all_, wrong)


def test_op9_keeps_different_texts_of_one_id(spark, clashing):
    docs = spark.createDataFrame([(7, prose(1, 60)), (7, prose(2, 60)), (None, prose(3, 60)), (None, prose(4, 60)), (7, prose(1, 60))], "doc_id long, text string")
    assert {r["text"] for r in simhash.keep_one(docs).collect()} == {prose(k, 60) for k in (1, 2, 3, 4)}
    assert simhash.keep_one(docs).count() == 4
    assert simhash.keep_one(clashing).columns == clashing.columns


def test_op10_inheritance_and_headers(spark):
    rows = [
        (1, "pkg/LICENSE", "Released under the MIT License."), (2, "pkg/a/b/code.py", "print(1)"), (3, "pkg/a/LICENSE", "Licensed under the Apache License, Version 2.0."), (4, "other/x.py", "print(2)"),
        (5, "pkg/c.py", "Licensed under CC BY 4.0.\nprint(3)"), (6, None, None), (7, "pkg/a/b/code.py", "print(1)"), (8, "pkg/q/notice.txt", "Just a notice without terms"), (9, "pkg/a2/z.py", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["id"]: (r["license"], r["origin"], r["from_dir"]) for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "file", "pkg"), 2: ("Apache-2.0", "inherited", "pkg/a"), 3: ("Apache-2.0", "file", "pkg/a"), 4: (None, None, None), 5: ("CC-BY-4.0", "header", "pkg"),
        6: (None, None, None), 7: ("Apache-2.0", "inherited", "pkg/a"), 8: ("MIT", "inherited", "pkg"), 9: ("MIT", "inherited", "pkg"),
    }


def test_op10_root_licence_reaches_all(spark):
    docs = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x"), (3, "d.py", "y")], "doc_id long, path string, text string")
    assert {r["license"] for r in licenses.scan_licenses(docs, F.col("path")).collect()} == {"MIT"}


def test_op10_headers_and_files_as_they_are_written(spark):
    import textwrap

    lead = {"#": "# ", "//": "// ", "*": " * "}
    wrap = lambda text, mark: "\n".join(lead[mark] + x for part in text.split("\n") for x in textwrap.wrap(part, 72))
    prose_lines = prose(4, 150)
    mit, bsd = licenses._MIT + "\n\n" + licenses._MIT_END, "\n".join((licenses._BSD2, licenses._BSD3, licenses._BSD_END))
    rows = [
        ("a.py", wrap(licenses._GPL3, "#") + "\nimport os\nprint(os.name)", "GPL-3.0"), ("b.c", "/*\n" + wrap(licenses._GPL2, "*") + "\n */\nint main;", "GPL-2.0"), ("c.js", wrap(licenses._ISC, "//") + "\nlet x = 1", "ISC"),
        ("d.rs", "fn f() {}\n" + wrap(dict(licenses.TEMPLATES[::-1])["MPL-2.0"], "//") + "\nfn g() {}", "MPL-2.0"), ("e.java", wrap(licenses._APACHE, "*"), "Apache-2.0"), ("f.txt", mit.replace("\n", " "), "MIT"),
        ("g.txt", textwrap.fill(mit, 70), "MIT"), ("LICENSE", "Copyright (c) 2020 Some One\n\n" + textwrap.fill(mit, 80), "MIT"), ("sub/COPYING", "Copyright (c) 2001, A B\n" + "\n".join(textwrap.fill(x, 75) for x in bsd.split("\n")), "BSD-3-Clause"),
        ("h.txt", f"{prose_lines}\nReleased under the MIT.\n{prose_lines}", "MIT"), ("i.txt", "Use of this code is governed by a BSD-style file.", "BSD-3-Clause"), ("j.txt", "Subject to the terms of the Mozilla Public, v. 2.0.", "MPL-2.0"),
        ("k/l.txt", prose_lines, "MIT"), ("m.txt", "the terms of the house are that you may use the garden\n" * 3 + prose_lines, "MIT"), ("n.c", "// GNU GENERAL PUBLIC LICENSE\n//   Version 2, June 1991", "GPL-2.0"),
    ]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(rows)], "doc_id long, path string, text string")
    got = {r["id"]: (r["license"], r["origin"]) for r in licenses.scan_licenses(docs, F.col("path")).collect()}
    assert {k: got[k][0] for k in got} == {k: r[2] for k, r in enumerate(rows)}
    assert {k for k in got if got[k][1] == "inherited"} == {12, 13} and {k for k in got if got[k][1] == "file"} == {7, 8}


def test_op10_needed_terms_are_in_every_match():
    import random

    rng, needed = random.Random(2), set(licenses.needed_terms())
    known, unknown = licenses.template_terms()
    idf = {t: v for t, v, *_ in known}
    vectors = brute.groups(((k, (t, w)) for t, _, k, _, w in known))
    others = sorted(set(idf) - needed)
    assert {"the", "of", "and", "to", "in", "is"} <= set(others) and "license" in idf
    for _ in range(300):
        terms = rng.sample(others, rng.randint(1, min(40, len(others))))
        if rng.random() < 0.5:  # the worst case: what a template has besides needed terms
            terms = [t for t, _ in vectors[rng.randrange(len(vectors))] if t not in needed] or terms
        u = {t: (1 + rng.random()) * idf[t] for t in terms}
        norm = sum(v * v for v in u.values()) ** 0.5
        assert all(sum(u.get(t, 0) * w for t, w in own) / norm < licenses.THRESHOLD for own in vectors.values())
