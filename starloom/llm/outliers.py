"""Quality rules: fixed rules, and robust multivariate outliers by minimum-covariance-determinant estimates.

DataFrame functions only. Statistics of each text are transformed to fixed-point numbers (1/1024), so that sums are
exact and reruns agree. For each language and source (a language, or all rows, where fewer than ``MIN_ROWS`` are there)
concentration steps are aggregates: moments of the rows nearest the centre, their Cholesky factor, new distances, the
distance quantile by an exact percentile over quantised distances. Two starts are followed and the smaller determinant
wins; a reweighted estimate and a chi-square cut-off give the verdict. Moments combine before the shuffle, whose rows are
one per group and task, so a source with a third of all rows costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, words_of

#: Smallest group that gets an estimate of its own; share of rows that a concentration step keeps; concentration steps.
MIN_ROWS, SUPPORT, STEPS = 50, 0.6, 4
NAMES = ("x1", "x2", "x3", "x4", "x5")
#: Standard deviations (of the transformed statistics) added to each estimate: differences below do not count as odd. Those of
#: repeated lines and words are small enough that either share alone can pass the cut-off (at some 0.44, where a group has none).
FLOORS = (0.08, 0.08, 0.13, 0.13, 0.08)
SCALE = 1024
#: Of 5 degrees of freedom: the median, the 0.975 quantile for reweighting, and the 0.9999 quantile as the verdict's cut-off.
CHI2_MEDIAN, CHI2_975, CHI2_CUT = 4.351, 12.833, 25.745
#: A per-group table of up to this many rows is broadcast.
BROADCAST_GROUPS = 20_000


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a window of three words found twice or more in it, first ones included."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))
        starts = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, k: same(s, e, k)), lambda e: e["i"])))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x))

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper) of whole texts; null: as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    only = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")
    return docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        of_words.alias("w"), of_lines.alias("l"), only("#*$%&|<>").alias("n_symbols"), only("A-ZÀ-ÖØ-Þ").alias("n_upper"),
    ).select("id", "lang", "source", "w.*", "n_symbols", "l.*", "n_upper")


def _transformed(stats: DataFrame) -> DataFrame:
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    raw = (F.log((F.col("word_chars") + 1) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_upper") / chars))
    return stats.withColumns({name: F.round(x * SCALE).cast("long") for name, x in zip(NAMES, raw, strict=True)})


_KEY = ("level", "a", "b")


def _keys(level: int) -> list[Column]:
    """The group of a row at a level: language and source, language, all; null has a name of its own."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return [F.lit(level).alias("level"), (known("lang") if level < 2 else F.lit("")).alias("a"), (known("source") if level < 1 else F.lit("")).alias("b")]


def _squared(x: list[Column], p) -> Column:
    """Squared Mahalanobis distance of x from the centre p(m1..), through the Cholesky factor p(l11..)."""
    z: list[Column] = []
    for i in range(len(x)):
        rest = x[i] - p(f"m{i}")
        for k in range(i):
            rest = rest - p(f"l{i}{k}") * z[k]
        z.append(rest / p(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Centre and Cholesky factor, with floors, of each group of rows; columns m0.., l00.., logdet, n."""
    d = len(NAMES)
    sums = {f"s{i}": F.sum(NAMES[i]) for i in range(d)} | {f"s{i}_{j}": F.sum(F.col(NAMES[i]) * F.col(NAMES[j])) for i in range(d) for j in range(i + 1)}
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in sums.items()])
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(d)})
    for i in range(d):
        step = {}
        for j in range(i + 1):
            cov = F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            cov = cov + F.lit((FLOORS[i] * SCALE) ** 2) if i == j else cov
            for k in range(j):
                cov = cov - (step[k] if k in step else F.col(f"l{i}{k}")) * (step[k] if i == j else F.col(f"l{j}{k}"))
            step[j] = F.sqrt(F.greatest(cov, F.lit(1.0))) if i == j else cov / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", step[j])
            step[j] = F.col(f"l{i}{j}")
    logdet = sum((F.log(f"l{i}{i}") for i in range(1, d)), F.log("l00"))
    return out.select(*by, "n", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)], logdet.alias("logdet"))


def _side(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_GROUPS else df


def estimates(rows: DataFrame) -> DataFrame:
    """One row for each group (level, a, b) of MIN_ROWS rows or more: m0.., l00.. and scale, so that distance / scale is chi-square."""
    x = [F.col(c) for c in NAMES]
    every = rows.select(*NAMES, F.explode(F.array(*[F.struct(*_keys(k)) for k in range(3)])).alias("key")).select(*NAMES, "key.*")
    half = every.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(f"c{i}") for i, c in enumerate(NAMES)])
    centre = stored(half.where(F.col("n") >= MIN_ROWS), "medians")
    n = 2 * centre.count()
    spread = every.join(_side(centre, n), list(_KEY)).groupBy(*_KEY).agg(*[F.percentile(F.abs(F.col(c) - F.col(f"c{i}")), F.lit(0.5)).alias(f"d{i}") for i, c in enumerate(NAMES)])
    scaled = stored(centre.join(spread, list(_KEY)), "spreads")
    quantised = lambda d2: F.floor(256 * F.log1p(d2)).cast("int")
    z = [F.abs(x[i] - F.col(f"c{i}")) / (1.4826 * F.col(f"d{i}") + FLOORS[i] * SCALE) for i in range(len(x))]
    first = F.array(F.struct(F.lit(0).alias("start"), sum((v * v for v in z[1:]), z[0] * z[0]).alias("d2")), F.struct(F.lit(1).alias("start"), F.pow(F.greatest(*z), 2).alias("d2")))
    by = [*_KEY, "start"]
    marked = every.join(_side(scaled, n), list(_KEY)).select(*_KEY, *NAMES, F.explode(first).alias("s")).select(*_KEY, *NAMES, "s.start", quantised(F.col("s.d2")).alias("q"))
    found = None
    for step in range(STEPS + 1):
        if found is not None:
            marked = every.join(_side(found, n), list(_KEY)).select(*by, *NAMES, quantised(_squared(x, F.col)).alias("q"))
        limit = marked.groupBy(*by).agg(F.percentile("q", F.lit(SUPPORT)).alias("most"))
        found = stored(_moments(marked.join(_side(limit, n), by).where("q <= most"), by), f"step{step}")
    best = found.groupBy(*_KEY).agg(F.min(F.struct("logdet", "start")).alias("best"))
    final = found.join(best, list(_KEY)).where(F.col("start") == F.col("best.start")).drop("best", "start", "logdet", "n")
    for name, keep in (("raw", True), ("reweighted", False)):
        d2 = every.join(_side(final, n), list(_KEY)).withColumn("d2", _squared(x, F.col))
        scale = d2.groupBy(*_KEY).agg((F.expm1(F.percentile(quantised(F.col("d2")), F.lit(0.5)) / 256) / F.lit(CHI2_MEDIAN)).alias("scale"))
        # floors make distances small throughout a very even group: these are not blown up
        final = stored(final.join(scale.withColumn("scale", F.greatest(F.col("scale"), F.lit(1.0))), list(_KEY)), name)
        if keep:
            near = every.join(_side(final, n), list(_KEY)).where(_squared(x, F.col) <= F.col("scale") * CHI2_975).select(*_KEY, *NAMES)
            final = stored(_moments(near, list(_KEY)).drop("logdet", "n"), "near")
    return final


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row of docs: id, the statistics, base_failed, distance (to the group's centre, over its scale) and kept.

    Fixed rules fail texts of under 50 words (null and empty ones too) or with over half of the words in repeated windows. The
    others are judged by their group: language and source, else language, else all; with fewer than MIN_ROWS even there,
    distance is null and they stay. Null languages and sources are groups of their own; repeated rows stay repeated.
    """
    stats = statistics(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(_transformed(stats.withColumn("base_failed", failed)), "statistics")
    final = estimates(rows.where("not base_failed"))
    n = final.count()
    out = rows
    fields = [c for c in final.columns if c not in _KEY]
    for k in range(2):
        side = _side(final.where(F.col("level") == k).select(F.col("a").alias(f"a{k}"), F.col("b").alias(f"b{k}"), F.struct(*fields).alias(f"p{k}")), n)
        key = _keys(k)
        out = out.join(side, (key[1] == F.col(f"a{k}")) & (key[2] == F.col(f"b{k}")), "left").drop(f"a{k}", f"b{k}")
    every = final.where("level = 2").select(*fields).first()  # one row, if there are enough
    out = out.withColumn("p", F.coalesce("p0", "p1", *([F.struct(*[F.lit(every[c]).alias(c) for c in fields])] if every else [])))
    distance = _squared([F.col(c) for c in NAMES], lambda name: F.col(f"p.{name}")) / F.col("p.scale")
    judged = out.withColumn("distance", F.when(~F.col("base_failed"), distance))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CHI2_CUT)
    return judged.withColumn("kept", kept).drop("p", "p0", "p1", *NAMES)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance) of every document.

    Null and empty texts count as empty and fail the fixed rules; null ids, languages and sources are kept as such; repeated rows each have
    their result; an empty table gives an empty result; other columns are not looked at.
    """
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 6).alias("distance"))


def _oracle_sql() -> str:
    """DuckDB text of op1: words and windows as rows, each concentration step as common table expressions."""
    d, key = range(len(NAMES)), "level, a, b"
    cells = [(i, j) for i in d for j in range(i + 1)]
    fields = ", ".join([*(f"m{i}" for i in d), *(f"l{i}{j}" for i, j in cells)])
    squared = lambda p="": ", ".join(
        [f"({NAMES[i]} - {p}m{i}" + "".join(f" - {p}l{i}{k} * z{k}" for k in range(i)) + f") / {p}l{i}{i} AS z{i}" for i in d] + [" + ".join(f"z{i} * z{i}" for i in d) + " AS d2"]
    )
    quantised = "CAST(floor(256 * ln(1 + d2)) AS BIGINT) AS q"

    def moments(rows: str, by: str, where: str) -> str:
        sums = ", ".join([*(f"sum({NAMES[i]}) AS s{i}" for i in d), *(f"sum({NAMES[i]} * {NAMES[j]}) AS s{i}_{j}" for i, j in cells)])
        steps = [f"s{i} / n AS m{i}" for i in d]
        for i in d:
            for j in range(i + 1):
                cov = f"s{i}_{j} / n - m{i} * m{j}" + (f" + {(FLOORS[i] * SCALE) ** 2!r}::DOUBLE" if i == j else "") + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                steps.append(f"sqrt(greatest({cov}, 1e0)) AS l{i}{j}" if i == j else f"({cov}) / l{j}{j} AS l{i}{j}")
        logdet = " + ".join(f"ln(l{i}{i})" for i in d)
        return f"SELECT {by}, {', '.join(steps)}, {logdet} AS logdet FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, {sums} FROM {rows} WHERE {where} GROUP BY {by})"

    word = r"[^\x20\x09-\x0D]+"
    only = lambda chars: f"CAST(length(regexp_replace(text, '[^{chars}]+', '', 'g')) AS BIGINT)"
    raw = ("ln((word_chars + 1) / greatest(n_words, 1))", "sqrt(n_symbols / greatest(n_words, 1))", "sqrt(n_dup_lines / greatest(n_lines, 1))", "sqrt(n_repeat_words / greatest(n_words, 1))", "sqrt(n_upper / greatest(word_chars, 1))")
    known = lambda c: f"coalesce('=' || {c}, 'null')"
    keys = [(known("lang"), known("source")), (known("lang"), "''"), ("''", "''")]
    parts = [
        "t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents)",
        f"w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM t)",
        "u AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS x FROM w)",
        "v AS (SELECT r, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY r ORDER BY i))",
        "c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM v WHERE z IS NOT NULL)",
        "p AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r)",
        "g AS (SELECT r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, "
        f"{only('#*$%&|<>')} AS n_symbols, {only('A-ZÀ-ÖØ-Þ')} AS n_upper, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r))",
        "f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, " + ", ".join(f"CAST(round({x} * {SCALE}) AS BIGINT) AS {n}" for x, n in zip(raw, NAMES, strict=True)) + " FROM g)",
        "e AS (" + " UNION ALL ".join(f"SELECT {k} AS level, {a} AS a, {b} AS b, {', '.join(NAMES)} FROM f WHERE NOT base_failed" for k, (a, b) in enumerate(keys)) + ")",
        f"med AS (SELECT {key}, " + ", ".join(f"quantile_cont({n}, 0.5) AS c{i}" for i, n in enumerate(NAMES)) + f" FROM e GROUP BY {key} HAVING count(*) >= {MIN_ROWS})",
        f"spr AS (SELECT {key}, " + ", ".join(f"quantile_cont(abs({n} - c{i}), 0.5) AS d{i}" for i, n in enumerate(NAMES)) + f" FROM e JOIN med USING ({key}) GROUP BY {key})",
        f"zs AS (SELECT {key}, {', '.join(NAMES)}, " + ", ".join(f"abs({n} - c{i}) / (1.4826::DOUBLE * d{i} + {FLOORS[i] * SCALE!r}::DOUBLE) AS z{i}" for i, n in enumerate(NAMES)) + f" FROM e JOIN med USING ({key}) JOIN spr USING ({key}))",
        f"q0 AS (SELECT {key}, 0 AS start, {', '.join(NAMES)}, " + " + ".join(f"z{i} * z{i}" for i in d) + f" AS d2, {quantised} FROM zs UNION ALL SELECT {key}, 1, {', '.join(NAMES)}, pow(greatest(" + ", ".join(f"z{i}" for i in d) + f"), 2) AS d2, {quantised} FROM zs)",
    ]
    for step in range(STEPS + 1):
        if step:
            parts.append(f"q{step} AS (SELECT {key}, start, {', '.join(NAMES)}, {squared()}, {quantised} FROM e JOIN f{step - 1} USING ({key}))")
        parts.append(f"h{step} AS (SELECT {key}, start, quantile_cont(q, {SUPPORT}::DOUBLE) AS most FROM q{step} GROUP BY {key}, start)")
        parts.append(f"f{step} AS ({moments(f'q{step} JOIN h{step} USING ({key}, start)', f'{key}, start', 'q <= most')})")
    parts.append(f"best AS (SELECT {key}, arg_min(start, (logdet, start)) AS start FROM f{STEPS} GROUP BY {key})")
    parts.append(f"raw0 AS (SELECT {key}, {fields} FROM f{STEPS} JOIN best USING ({key}, start))")
    for name, source in (("raw", "raw0"), ("re", "near")):
        if name == "re":
            parts.append(f"far AS (SELECT {key}, {', '.join(NAMES)}, scale, {squared()} FROM e JOIN raw USING ({key}))")
            parts.append(f"near AS ({moments('far', key, f'd2 <= scale * {CHI2_975}::DOUBLE')})")
        parts.append(f"{name}q AS (SELECT {key}, {squared()}, {quantised} FROM e JOIN {source} USING ({key}))")
        parts.append(f"{name} AS (SELECT {key}, {fields}, scale FROM {source} JOIN (SELECT {key}, greatest(1e0, (exp(quantile_cont(q, 0.5) / 256) - 1) / {CHI2_MEDIAN}::DOUBLE) AS scale FROM {name}q GROUP BY {key}) USING ({key}))")
    chosen = ", ".join(f"CASE WHEN k0.scale IS NOT NULL THEN k0.{c} WHEN k1.scale IS NOT NULL THEN k1.{c} ELSE k2.{c} END AS {c}" for c in [*(x.strip() for x in fields.split(",")), "scale"])
    joins = " ".join(f"LEFT JOIN re k{k} ON k{k}.level = {k} AND k{k}.a = {a} AND k{k}.b = {b}" for k, (a, b) in enumerate(keys))
    parts.append(f"o AS (SELECT f.*, {chosen} FROM f {joins})")
    parts.append(f"r AS (SELECT *, {squared()}, CASE WHEN NOT base_failed THEN d2 / scale END AS dist FROM o)")
    out = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(dist, 0) <= {CHI2_CUT}::DOUBLE AS kept, round(dist, 6) AS distance FROM r"
    return f"WITH {', '.join(parts)} {out}"


ORACLE_SQL = _oracle_sql()
