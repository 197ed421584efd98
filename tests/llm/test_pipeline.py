"""Each pipeline stage against a brute-force version, on what the stage before kept."""

import hashlib
from array import array
from collections import Counter

import brute
import corpus_pipeline
import pyarrow as pa
import pytest
from llm_tables import SCHEMA, as_dir, odd_rows, prose
from pyspark.sql import functions as F
from starloom.llm import bpe, simhash
from starloom.llm.common import BATCH_LIMIT, SPACE

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    rows = [(*r[:1], prose(5, 600), *r[2:]) if len(r[1] or "") > 20_000 else r for r in odd_rows()]  # all pairs of lines are compared below
    odd = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, int(k not in (10, 11)), 0) for k in range(-3, 14)], "doc_id long, quality int, toxic int")
    return as_dir(spark, tmp_path_factory.mktemp("pipeline"), documents=odd, labels=labels)


def linededup_hash(spark, text, known={}):  # noqa: B006
    """The hash that orders rows of one id, as Spark takes it."""
    if text not in known:
        known[text] = spark.range(1).select(F.xxhash64(F.lit(text).cast("string"))).first()[0]
    return known[text]


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, small_dir)
        if name != "bpe":
            assert out.columns == docs.columns
        seen[name] = (before, [tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(seen[name][1], docs.schema) if name != "bpe" else docs

    before, after = seen["quality"]
    assert not Counter(after) - Counter(before)

    before, after = seen["line_dedup"]
    # of each class of lines the first one by id (null last), row and number stays; rows equal in id and text are treated alike
    place = lambda r: (r[0] is None, r[0] or 0, linededup_hash(spark, r[1]))
    placed = sorted({(*place(r), n, x.strip(SPACE)) for r in before for n, x in enumerate((r[1] or "").split("\n")) if x.strip(SPACE)})
    distinct = sorted({p[-1] for p in placed}, key=len)
    root = brute.classes(len(distinct), lambda i, j: brute.same_line(distinct[i], distinct[j]))
    label, first = dict(zip(distinct, root, strict=True)), {}
    for p in placed:
        first.setdefault(label[p[-1]], p[:-1])
    want = Counter()
    for r in before:
        kept = [x for n, x in enumerate((r[1] or "").split("\n")) if not x.strip(SPACE) or first[label[x.strip(SPACE)]] == (*place(r), n)]
        text = None if r[1] is None else "\n".join(kept)
        want[(r[0], text, r[2], r[3], None if text is None else len(text))] += 1
    assert Counter(after) == want

    before, after = seen["near_dedup"]
    prints = [brute.wide_fingerprint(r[1]) for r in before]
    root = brute.classes(len(prints), lambda i, j: brute.similar(prints[i], prints[j], simhash.reach(0.8)))
    first = {}
    for k in sorted(range(len(before)), key=lambda k: place(before[k])):
        first.setdefault(root[k], before[k])
    assert Counter(after) == Counter(first.values())

    before, after = seen["mix"]
    assert set(after) <= set(before) and all(n <= 2 * Counter(before)[r] for r, n in Counter(after).items())
    want = brute.targets({s: sum(v) for s, v in brute.groups((r[3], len(brute.words(r[1]))) for r in before).items()})
    got = brute.groups((r[3], len(brute.words(r[1]))) for r in after)
    sizes = brute.groups((r[3], len(brute.words(r[1]))) for r in before)
    for s in want:
        assert abs(sum(got.get(s, [0])) - want[s]) <= max(sizes[s], default=0)

    before, after = seen["bpe"]
    own = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    expect = Counter()
    for r in before:
        ids = own.encode(r[1] or "", add_special_tokens=False).ids
        expect[(r[0], len(ids), tuple(ids), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert Counter((r[0], r[1], tuple(r[2]), r[3]) for r in after) == expect


def test_run_equals_stages_in_turn(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert len(odd_rows()) > 0 and corpus_pipeline.run(spark, small_dir).count() > 0


def test_empty_input(spark, empty, tmp_path):
    where = as_dir(spark, tmp_path, documents=empty, labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, where).count() == 0


@pytest.mark.parametrize("name, stage", [x for x in corpus_pipeline.STAGES if x[0] != "mix"])
def test_stages_bound_arrow_batches_by_bytes(spark, small_dir, name, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    long = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("word "), 10_000).alias("text"))  # 20 MB in one partition
    seen = lambda: [tuple(r) for r in long.mapInArrow(sizes, "rows long, bytes long").collect()]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(3)
    try:
        spark.conf.unset(BATCH_LIMIT)
        stage(spark, docs, small_dir)
        assert sum(n for n, _ in seen()) == 400 and max(size for _, size in seen()) < 3_000_000
        spark.conf.set(BATCH_LIMIT, "8m")  # a bound of the session's own stays
        stage(spark, docs, small_dir)
        assert spark.conf.get(BATCH_LIMIT) == "8m"
    finally:
        spark.conf.unset(BATCH_LIMIT)


def test_ids_of_words_are_packed_as_bytes():
    ids = [[5, 70_000], [], [1 << 31]]
    packed = bpe._pack_ids([array("I", x).tobytes() for x in ids])
    assert [[i & 0xFFFFFFFF for i in x] for x in bpe._unpack_ids(packed).to_pylist()] == ids
