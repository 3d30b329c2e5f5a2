"""Compare two datasets, given as paths or DataFrames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions import where
from rowlens.functions.canon import canonical, quoted
from rowlens.operators import classified, keyed, multiset, snapshot
from rowlens.operators.infer import infer_key
from rowlens.output.export import export
from rowlens.plans.options import Options, Plan, allowed, build_plan, parse_budget
from rowlens.plans.schema import SchemaDiff, check_renames, columns_of, compare, rename
from rowlens.result import Result
from rowlens.sources import scratch
from rowlens.sources.dataset import Dataset, open_dataset, open_pair

#: Slices of the keys, by hash; early abort compares the first.
SLICES = 64


def _dataset(spark: SparkSession, source, options: Options, text_columns: frozenset = frozenset()) -> Dataset:
    return Dataset(source) if isinstance(source, DataFrame) else open_dataset(spark, source, options.infer_rows, options.delimiter, text_columns)


def _prepare(data: Dataset, options: Options, renames: dict[str, str] | None = None):
    """The filtered, renamed table and its columns."""
    cols, warnings = columns_of(data.df.schema)
    predicates = where.parse(options.where)
    df = data.df.where(where.condition(predicates, cols)) if predicates else data.df
    if renames:
        df = rename(df, renames)
        cols, _ = columns_of(df.schema)
    return df, cols, [*data.warnings, *warnings]


def prepare(left: DataFrame, right: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, Plan]:
    """Resolve options against two DataFrames. Runs a job only where a key has to be inferred."""
    options.check()
    a, left_cols, _ = _prepare(Dataset(left), options)
    renames = check_renames(left.columns, right.columns, options.rename)
    b, right_cols, _ = _prepare(Dataset(right), options, renames)
    schema = compare(left_cols, right_cols, renames)
    key = options.key or ([] if options.keyless else [infer_key(a, b, schema)])
    return a, b, build_plan(schema, options, left_cols, right_cols, key)


def classify(left: DataFrame, right: DataFrame, options: Options) -> tuple[DataFrame, Plan]:
    """The lazily classified rows of two DataFrames (see :mod:`rowlens.operators.classified`)."""
    a, b, plan = prepare(left, right, options)
    if options.keyless or options.on_dup == "match":
        return multiset.classify(a, b, plan), plan
    return (keyed.classify_first if options.on_dup == "warn" else keyed.classify)(a, b, plan), plan


def schema_diff(spark: SparkSession, left, right, options: Options | None = None) -> SchemaDiff:
    options = options or Options()
    a, b = _dataset(spark, left, options), _dataset(spark, right, options)
    renames = check_renames(a.df.columns, b.df.columns, options.rename)
    return compare(columns_of(a.df.schema)[0], columns_of(rename(b.df, renames).schema)[0], renames)


def diff(spark: SparkSession, left, right, options: Options | None = None) -> Result:
    """Compare; text inputs whose later rows contradict the inferred type are read again with that column as text."""
    options = options or Options()
    options.check()
    folded = pruned = 0
    if isinstance(left, str) and isinstance(right, str) and not options.where:
        a, b, folded = open_pair(spark, left, right, options.infer_rows, options.delimiter)
    else:
        a, b = _dataset(spark, left, options), _dataset(spark, right, options)
    notes = []
    bad = a.contradictions() | b.contradictions()
    if bad:
        a, b = (x if isinstance(s, DataFrame) else x.retyped(bad) for x, s in ((a, left), (b, right)))
        notes += [f"column {c!r} read as text: a value does not fit the inferred type" for c in sorted(bad)]
    if options.where:
        predicates = where.parse(options.where)
        a, pa = a.pruned(predicates)
        b, pb = b.pruned(predicates)
        pruned = pa + pb
    result = _run(spark, a, b, options)
    result.files_pruned = pruned
    result.notes = notes + result.notes
    if folded:
        result.fold(folded)
        result.notes.append(f"{folded} rows in files that both sides share were not read")
    return result


def _run(spark: SparkSession, left: Dataset, right: Dataset, options: Options) -> Result:
    a, left_cols, wa = _prepare(left, options)
    renames = check_renames(left.df.columns, right.df.columns, options.rename)
    b, right_cols, wb = _prepare(right, options, renames)
    schema = compare(left_cols, right_cols, renames)
    out = Result(schema, comparison=options.comparison(), masked=list(options.mask), keyless=options.keyless, filter=where.render(where.parse(options.where)))
    out.notes = [f"left: {w}" for w in wa] + [f"right: {w}" for w in wb]
    key = list(options.key)
    if not key and not options.keyless:
        key = [infer_key(a, b, schema)]
        out.notes.append(f"key inferred: {key[0]}")
    out.key = key
    plan = build_plan(schema, options, left_cols, right_cols, key)
    whole = options.keyless or options.on_dup == "match"
    if options.max_diff is not None and not whole and not options.output and options.mode != "stream" and _blown(out, a, b, plan, options):
        return out
    unique = not whole and options.on_dup == "error"
    sizes = keyed.refuse_duplicates(a, b, plan) if unique else None
    if options.summary:
        counted = multiset.counts(a, b, plan) if whole else keyed.count_first(keyed.classify_first(a, b, plan)) if options.on_dup == "warn" else keyed.summarize(a, b, plan)
        _fill(out, counted.first().asDict())
        return out
    rows = multiset.classify(a, b, plan) if whole else _classified(a, b, plan, options)
    counts = [*classified.count_columns(), *(keyed.dup_columns() if options.on_dup == "warn" else [])]
    aggregates, path = [*counts, *classified.stat_columns(plan)], scratch.new_path(spark, "differing")
    try:
        if unique and not plan.tolerant:  # one join: unchanged rows are what is left of a side
            differing = classified.detailed(_written(spark, keyed.classify(a, b, plan, details=False), path), plan)
            row = differing.agg(*aggregates).first().asDict()
            row["left_rows"], row["right_rows"] = sizes
            row["unchanged"] = sizes[0] - row["removed"] - row["changed"]
        else:
            differing, row = None, rows.agg(*aggregates).first().asDict()
        _fill(out, dict(list(row.items())[: len(counts)]))
        if options.on_dup == "match":
            per = multiset.counts(a, b, plan).first()
            out.dup_keys, out.dup_rows = per["dup_keys"], per["dup_rows"]
            out.dup_examples = [r["key"] for r in keyed.duplicates(a, plan).orderBy("key").limit(options.limit).collect()] if out.dup_keys else []
        if options.max_diff is not None and not options.output and options.on_dup != "match":
            most = allowed(parse_budget(options.max_diff), out.left_rows, out.right_rows)
            if out.added + out.removed + out.changed > most:
                out.aborted, out.abort_reason = True, f"budget of {most} exceeded: {out.added + out.removed + out.changed} rows differ"
                return out
        if differing is None and (not out.rows_same and options.limit or options.output):
            differing = _written(spark, rows, path)
        if not out.rows_same:
            if plan.keys and out.changed:
                out.column_stats = classified.stats_of(row, plan, out.changed + out.unchanged + out.within_tolerance)
            for r in classified.examples(differing, plan, options.limit).collect() if options.limit else []:
                if r["status"] == classified.CHANGED:
                    out.changed_examples.append({"key": r["key"], "columns": [c.asDict() for c in r["columns"]]})
                else:
                    (out.added_examples if r["status"] == classified.ADDED else out.removed_examples).append(r["key"])
        out.rows = rows
        if options.output:
            export(classified.named(differing, plan), options.output, plan)
    finally:
        scratch.remove(spark, path)
    return out


def _classified(a: DataFrame, b: DataFrame, plan: Plan, options: Options) -> DataFrame:
    return (keyed.classify_first if options.on_dup == "warn" else keyed.classify)(a, b, plan)


def _written(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The differing ones of classified rows, written to the shared folder, so that what follows joins nothing."""
    rows.where(F.col("status").isin(classified.ADDED, classified.REMOVED, classified.CHANGED)).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _blown(out: Result, a: DataFrame, b: DataFrame, plan: Plan, options: Options) -> bool:
    """Early abort: one slice of the keys in ``SLICES`` is compared first. If its differing rows alone exceed the budget, the
    comparison ends with the slice's counts, which are lower bounds."""
    how, x = budget = parse_budget(options.max_diff)
    most = int(x) if how == "rows" else allowed(budget, *(df.count() for df in (a, b)))
    side = lambda df, s: df.where(F.pmod(F.xxhash64(*(canonical(quoted(f.name), (f.left if s == "l" else f.right).kind, f.domain, options) for f in plan.keys)), F.lit(SLICES)) == 0)
    a, b = side(a, "l"), side(b, "r")
    if options.on_dup == "error":
        keyed.refuse_duplicates(a, b, plan)
    row = _classified(a, b, plan, options).agg(*classified.count_columns()).first().asDict()
    found = row["added"] + row["removed"] + row["changed"]
    if found <= most:
        return False
    _fill(out, row)
    out.aborted = out.partial_counts = True
    out.abort_reason = f"budget of {most} exceeded: {found} rows differ in the first of {SLICES} slices of the keys"
    return True


def _fill(out: Result, row: dict) -> None:
    for name, value in row.items():
        setattr(out, name, value)


def create_baseline(spark: SparkSession, source, path: str, options: Options | None = None) -> dict:
    options = options or Options()
    df, cols, _ = _prepare(_dataset(spark, source, options), options)
    key = options.key or [infer_key(df, df, compare(cols, cols))]
    return snapshot.write(df, path, options, key)


def diff_baseline(spark: SparkSession, path: str, source, options: Options | None = None) -> Result:
    """Counts against a baseline, with the keys of added and changed rows."""
    options = options or Options()
    if options.on_dup == "match":
        raise DiffError("a baseline can't match duplicates")
    df, cols, _ = _prepare(_dataset(spark, source, options), options)
    rows, plan, header = snapshot.compare_with(df, path, replace(options, key=[]))
    out = Result(compare(cols, cols), comparison=replace(options, **{s: header[s] for s in snapshot._SETTINGS}).comparison(), masked=list(options.mask), filter=header["where"], key=header["keys"])
    _fill(out, classified.counts(rows).first().asDict())
    key = classified.key_shown(plan)
    for status, into in ((classified.ADDED, out.added_examples), (classified.CHANGED, out.changed_examples)):
        for r in rows.where(F.col("status") == status).select(key.alias("key")).orderBy("key").limit(options.limit).collect():
            into.append(r["key"] if into is out.added_examples else {"key": r["key"], "columns": []})
    return out
