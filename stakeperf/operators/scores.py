"""Score ingest: nested round records -> flat, filtered, typed score rows.

Input (nested): one row per round record with outer fields (``model_name``,
``roundNumber``, ``atRisk`` ...) and ``intraRoundSubmissionScores``, an array
of score structs.  ``seq`` (the position of a score inside its record) is
assigned here, at ingest, and is the tie-break of every later ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from stakeperf.config import SCORE_METRICS
from stakeperf.functions.columns import as_number, blank_to_null, date_of_text, r_text
from stakeperf.operators.windows import MIN_LONG, null_safe_keys

SCORES = "intraRoundSubmissionScores"
SCORE_PREFIX = SCORES + "."
#: The score fields that the source keeps as text.
TEXT_FIELDS = ("date", "day", "displayName", "payoutPending", "payoutSettled", "percentile", "value")


def _outer_columns(nested: DataFrame, scores: str) -> list[str]:
    return [c for c in nested.columns if not c.startswith(scores)]


def _score_fields(nested: DataFrame, scores: str) -> list[str]:
    dt = nested.schema[scores].dataType
    assert isinstance(dt, ArrayType) and isinstance(dt.elementType, StructType)
    return dt.elementType.fieldNames()


def flatten_scores(nested: DataFrame, scores: str = SCORES) -> DataFrame:
    """One row per score; a record without scores keeps one row of NULLs.

    ``posexplode_outer`` keeps each score next to its own record, which is
    what the positional ``cbind`` of the reference intends.
    """
    outer = _outer_columns(nested, scores)
    fields = _score_fields(nested, scores)
    return (nested.select(*outer, F.posexplode_outer(scores).alias("seq", "_s"))
            .select(*outer, F.col("seq").cast("bigint").alias("seq"),
                    *[F.col("_s")[f].alias(f) for f in fields]))


def null_scores_default(nested: DataFrame, scores: str = SCORES) -> DataFrame:
    """Replace a NULL score list by one default row of NULLs, then flatten."""
    elem = nested.schema[scores].dataType.elementType
    default = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in elem.fields]))
    outer = _outer_columns(nested, scores)
    fields = elem.fieldNames()
    return (nested.select(*outer, F.posexplode(F.coalesce(F.col(scores), default)).alias("seq", "_s"))
            .select(*outer, F.col("seq").cast("bigint").alias("seq"),
                    *[F.col("_s")[f].alias(f) for f in fields]))


def filter_scores(flat: DataFrame, metrics: Sequence[str] = SCORE_METRICS) -> DataFrame:
    """Keep the configured metrics (the documented intent: ``displayName IN``)."""
    return flat.where(F.col("displayName").isin(list(metrics)))


def score_row_index(flat: DataFrame, model: str = "model_name", record: str | None = None,
                    seq: str = "seq", seq_block: int = 1 << 16, record_block: int = 1 << 12) -> DataFrame:
    """Add ``row_index`` (1-based) of every row inside its model, in record
    order (``rec_pos``, or the round number where records carry no position;
    NULL first), then ``seq`` (NULL first).

    Rows are numbered inside blocks (model, record, seq div ``seq_block``), and
    blocks get offsets in two steps: inside runs of ``record_block`` records,
    and over the runs of a model.  So no window holds more than ``seq_block``
    rows, the blocks of ``record_block`` records, or one row per run; merge
    joins add the offsets back.  The input is read twice.
    """
    record = record or ("rec_pos" if "rec_pos" in flat.columns else "roundNumber")
    x, kcols = null_safe_keys(flat, [model, record], "_r")
    mk, (rec_null, rec) = kcols[:2], kcols[2:]
    x = x.withColumn("_sb", F.coalesce(F.floor(F.col(seq) / seq_block), F.lit(MIN_LONG)))
    x = x.withColumn("_run", F.when(F.col(rec_null), F.lit(MIN_LONG)).otherwise(F.floor(F.col(rec) / record_block)))
    blk = [*mk, "_run", rec_null, rec, "_sb"]
    ranked = x.withColumn("_i", F.row_number().over(
        Window.partitionBy(*blk).orderBy(F.col(seq).asc_nulls_first())))
    blocks = x.groupBy(*blk).agg(F.count(F.lit(1)).alias("_n"))
    until = (Window.unboundedPreceding, -1)
    in_run = Window.partitionBy(*mk, "_run").orderBy(rec, "_sb").rowsBetween(*until)
    runs = blocks.groupBy(*mk, "_run").agg(F.sum("_n").alias("_n"))
    in_model = Window.partitionBy(*mk).orderBy("_run").rowsBetween(*until)
    run_offsets = runs.select(*mk, "_run", F.coalesce(F.sum("_n").over(in_model), F.lit(0)).alias("_run_off"))
    offsets = (blocks.select(*blk, F.coalesce(F.sum("_n").over(in_run), F.lit(0)).alias("_off"))
               .join(run_offsets.hint("merge"), [*mk, "_run"], "inner"))
    return (ranked.join(offsets.hint("merge"), blk, "inner")
            .withColumn("row_index", (F.col("_run_off") + F.col("_off") + F.col("_i")).cast("bigint"))
            .drop("_run_off", "_off", "_i", "_sb", "_run", *kcols))


def document_scores(docs: DataFrame, records: str = "records", scores: str = SCORES, model: str = "model_name") -> DataFrame:
    """Flat score rows of documents or their parts (model, array of round records, the place
    of the first of them in the document, ``rec_pos``, and the rows before it,
    ``first_row``), as ``flatten_scores`` gives them for the exploded records, with
    ``rec_pos`` and ``row_index``.

    The records' scores are laid end to end inside the row and exploded with their
    positions; a record without scores takes one place, as it gives one row of NULLs."""
    record = docs.schema[records].dataType.elementType
    outer = [f.name for f in record.fields if f.name != scores]
    fields = record[scores].dataType.elementType.fieldNames()

    def rows(r: Column, k: Column) -> Column:
        own = [r[c].alias(c) for c in outer]
        place = (F.col("rec_pos") + k).cast("bigint").alias("rec_pos")
        each = F.transform(r[scores], lambda s, j: F.struct(*own, place, j.cast("bigint").alias("seq"), *[s[f].alias(f) for f in fields]))
        types = {f.name: f.dataType for f in record[scores].dataType.elementType.fields}
        none = F.struct(*own, place, F.lit(None).cast("bigint").alias("seq"), *[F.lit(None).cast(types[f]).alias(f) for f in fields])
        return F.when(F.size(r[scores]) > 0, each).otherwise(F.array(none))

    present = F.filter(F.transform(records, lambda r, k: F.struct(r.alias("r"), k.alias("k"))), lambda x: x.r.isNotNull())
    flat = docs.select(model, "first_row", F.posexplode(F.flatten(F.transform(present, lambda x: rows(x.r, x.k)))).alias("_i", "_s"))
    return flat.select(model, *[F.col("_s")[c].alias(c) for c in (*outer, "rec_pos", "seq", *fields)], (F.col("first_row") + F.col("_i") + 1).cast("bigint").alias("row_index"))


def filter_scores_parity(flat: DataFrame, metrics: Sequence[str] = SCORE_METRICS) -> DataFrame:
    """The filter as the reference's code actually evaluates it: element-wise
    ``displayName == c(m1, m2)`` with recycling, so row i of a model is kept
    when its metric equals ``metrics[(i - 1) % len(metrics)]``.  Rows that carry their
    ``row_index`` (``document_scores``) are filtered where they are."""
    metrics = list(metrics)
    indexed = flat if "row_index" in flat.columns else score_row_index(flat)
    slot = (F.col("row_index") - 1) % len(metrics)
    wanted = F.element_at(F.array(*[F.lit(m) for m in metrics]), (slot + 1).cast("int"))
    return indexed.where(F.col("displayName") == wanted).drop("row_index")


def stringify_scores(flat: DataFrame, list_columns: Sequence[str] | None = None) -> DataFrame:
    """R ``across(where(is.list), ~ sapply(., toString))``: the score fields
    (list columns in the reference) become text, NULL becomes ``""``.

    A cell's own text comes from a step before, so it is made once, not at each use."""
    cols = list(list_columns) if list_columns is not None else [c for c in TEXT_FIELDS if c in flat.columns]
    types = {f.name: f.dataType for f in flat.schema.fields}
    text = flat.select([F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in flat.columns])
    return text.select([r_text(c, types[c]).alias(c) if c in cols else F.col(c) for c in flat.columns])


def round_numbers(nested: DataFrame, model: str = "model_name", rnd: str = "roundNumber") -> DataFrame:
    """Distinct round numbers per model."""
    return nested.select(model, rnd).distinct()


def model_ids(names: DataFrame, registry: DataFrame, model: str = "model_name") -> DataFrame:
    """Look up each model's id; NULL when the registry does not know it.
    The registry is a dimension: AQE broadcasts it when its measured size
    is below the adaptive threshold and shuffles it otherwise."""
    return names.select(model).distinct().join(registry, model, "left")


def clean_scores(flat: DataFrame) -> DataFrame:
    """Strip the nested-column prefix from names, cast ``day``,
    ``payoutPending`` and ``atRisk`` to double (failures -> NULL) and make
    blank date text NULL."""
    renamed = flat.toDF(*[c.replace(SCORE_PREFIX, "", 1) if c.startswith(SCORE_PREFIX) else c
                          for c in flat.columns])
    numeric = {"day", "payoutPending", "atRisk"}
    out = []
    for c in renamed.columns:
        if c in numeric:
            out.append(as_number(c).alias(c))
        elif c == "date":
            out.append(blank_to_null(F.col(c).cast("string")).alias(c))
        else:
            out.append(F.col(c))
    return renamed.select(out)


def run_summary(registry: DataFrame, nested: DataFrame, model: str = "model_name") -> DataFrame:
    """One row: models expected, models with score records, failures, and the names of
    the failed ones in order, comma-joined (empty if none failed).  A model fails when no
    record arrived for it; failures do not stop the others (they are rows of the same
    job).  The registry is configuration, so its failed names fit one cell."""
    seen = nested.select(model).distinct().withColumn("_ok", F.lit(True))
    status = (registry.select(model).distinct().join(seen, model, "left")
              .withColumn("_ok", F.coalesce("_ok", F.lit(False))))
    return status.agg(
        F.count(F.lit(1)).alias("total_models"),
        F.coalesce(F.sum(F.col("_ok").cast("bigint")), F.lit(0)).alias("successful"),
        F.coalesce(F.sum((~F.col("_ok")).cast("bigint")), F.lit(0)).alias("failed"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("_ok"), F.col(model)))), ", ").alias("failed_names"),
    )


#: Cells that are read as dates or numbers.
PARSED = ("date", "day", "payoutPending", "atRisk")


def _rejected(c: str) -> Column:
    """Whether a cell holds text that is no date, or no number."""
    text = blank_to_null(F.col(c).cast("string"))
    parsed = date_of_text(F.col(c).cast("string")) if c == "date" else as_number(c)
    return text.isNotNull() & parsed.isNull()


def rejected_cells(flat: DataFrame, model: str = "model_name", keys: Sequence[str] = ("roundNumber", "seq")) -> DataFrame:
    """The rejected cells themselves, one row each: (model, keys, column, cell).  The row
    stays in the run and the cell counts as missing there."""
    cells = F.array(*[F.when(_rejected(c), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell"))) for c in PARSED if c in flat.columns])
    bad = F.filter(cells, lambda x: x.isNotNull())
    return flat.select(model, *keys, F.explode(bad).alias("_c")).select(model, *keys, "_c.column", "_c.cell")


def model_status(registry: DataFrame, flat: DataFrame, model: str = "model_name") -> DataFrame:
    """One row per registered model: whether rows arrived, how many, and how
    many of them have date text that is no date, or text in ``day``,
    ``payoutPending`` or ``atRisk`` that is no number.  Such rows stay in the
    run; the bad cell counts as missing (``rejected_cells`` lists them)."""
    counts = flat.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.coalesce(F.sum(_rejected(c).cast("bigint")), F.lit(0)).alias(f"bad_{c}") for c in PARSED])
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts.columns if c != model]
    return (registry.select(model).distinct().join(counts, model, "left")
            .select(model, F.col("n_rows").isNotNull().alias("ok"), *zero))
