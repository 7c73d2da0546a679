"""Sections of agent steps as numbered pieces, for steps longer than a row.

``parse_agent_log_lines`` gives a section as one string.  Here a step may hold any number of lines: they
are read by many tasks and its sections come out as pieces of bounded size.

What a line does to the section that is open is a function of the section: it opens one (an event line, a
step's first line), closes code (a border), or changes nothing.  Such functions compose to one of the
same three forms, so a range of lines is summed up by one of them.  The ranges' summaries, one row each,
are composed in order (an associative scan), and every line's own function is applied to the section that
is open where its range begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from runlens.functions.text import py_strip, splitlines
from runlens.operators import agentlog as A
from runlens.operators._plan import range_keys, ranges_for

#: What lines do to the open section: nothing, close code, or (0 and more) open this kind.
SAME, CLOSE = -1, -2
PIECE_CHARS = 1 << 20
_SECTIONS = {A.CODE: "code", A.WARN: "warnings", A.LOGS: "execution_logs"}
_ADDED = [StructField(n, t) for n, t in (("_rng", IntegerType()), ("_row", LongType()), ("_first", BooleanType()), ("_steps", LongType()),
                                         ("_does", IntegerType()), ("_chunk", LongType()), ("_end", BooleanType()))]


def then(before: int, after: int) -> int:
    """The composition of two line functions."""
    if after == CLOSE:
        return CLOSE if before == SAME else A.NONE if before == A.CODE else before
    return before if after == SAME else after


def _scan_range(batches, piece_chars: int):
    """Number the steps and compose the functions along one sorted range; ``_end``: last line of its run (missing: not known here)."""
    import pyarrow as pa
    from pyspark import TaskContext

    rng, run, nth, row, steps, does, chars = TaskContext.get().partitionId(), None, -1, 0, 0, SAME, 0
    held = None

    def flush(following):
        batch, added, last = held
        added[-1][-1] = None if following is None else following[0] != last
        columns = [pa.array(values, type=kind) for values, kind in zip(added, (pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in _ADDED]])

    for batch in batches:
        if not batch.num_rows:
            continue
        runs = batch.column("_run").to_pylist()
        if held is not None:
            yield flush([runs[0]])
        added = [[] for _ in _ADDED]
        for key, starts, event, border, size in zip(runs, *(batch.column(c).to_pylist() for c in ("_starts", "_ev", "_border", "_size"))):
            if nth < 0 or key != run:
                run, nth, steps = key, nth + 1, 0
                does = SAME if nth == 0 else A.NONE
            if starts:
                steps, does = steps + 1, A.NONE
            does = then(does, event if event else CLOSE if border else SAME)
            chars += size
            for values, value in zip(added, (rng, row, nth == 0, steps, does, chars // piece_chars, False)):
                values.append(value)
            row += 1
        added[-1][:-1] = [a != b for a, b in zip(runs, runs[1:])]
        held = (batch, added, runs[-1])
    if held is not None:
        yield flush(None)


def _stated(lines: DataFrame, n_ranges: int | None, piece_chars: int) -> DataFrame:
    """Lines with their step (from 1) and the section that is open behind them; written."""
    from runlens.session import materialize, ship_package
    spark = lines.sparkSession
    ship_package(spark)
    order = ["_run", "_pos", "_sub"]
    ranged = lines.repartitionByRange(ranges_for(lines, n_ranges), *range_keys(lines, order)).sortWithinPartitions(*order)
    schema = StructType([*lines.schema.fields, *_ADDED])
    scanned = materialize(ranged.mapInArrow(lambda batches: _scan_range(batches, piece_chars), schema), "agent-lines")
    key = F.struct("_run")
    ranges = scanned.groupBy("_rng").agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.bool_and("_first").alias("single"),
        F.max_by(F.struct("_does", "_steps"), "_row").alias("sum")).orderBy("_rng").collect()
    starts, run, kind, steps = [], None, A.NONE, 0
    for r, following in zip(ranges, [*ranges[1:], None]):
        first, last = tuple(r["first"]), tuple(r["last"])
        opened = (kind, steps) if run == first else (A.NONE, 0)
        starts.append((r["_rng"], *opened, following is None or tuple(following["first"]) != last))
        does, count = r["sum"]
        run, kind, steps = last, then(opened[0], does), count + (opened[1] if r["single"] else 0)
    table = spark.createDataFrame(starts, "_rng int, _open int, _before long, _closes boolean")
    j = scanned.join(F.broadcast(table), "_rng")                 # one row per range
    open_ = F.when(F.col("_does") >= 0, F.col("_does")).when((F.col("_does") == CLOSE) & (F.col("_open") == A.CODE), F.lit(A.NONE)).otherwise(F.col("_open"))
    step = F.col("_steps") + F.when(F.col("_first"), F.col("_before")).otherwise(0)
    # A log's last line has no line break behind it, so an empty rest after its last one is no line.
    none = F.col("_rest") & F.coalesce("_end", "_closes")
    return j.select("*", open_.alias("_state"), step.alias("_step")).where((F.col("_step") > 0) & ~none)


def agent_step_pieces(lines: DataFrame, run_col: str = "run_id", pos_col: str = "pos", line_col: str = "line",
                      n_ranges: int | None = None, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """X3 without a bound on a step: (run, step_pos, section, piece, text) from logs held as lines.

    Sections are ``code``, ``warnings``, ``execution_logs``, ``out`` (one piece, the last one of the step, as
    ``parse_steps`` gives it) and ``raw_text`` (for steps that have none of them).  The pieces of a section, in
    the order of ``piece`` and joined with a line feed, are the section's text before it is stripped; a
    section without lines has no piece.  ``piece`` says the order only: it has gaps, and cuts depend on the ranges.
    A piece holds about ``piece_chars`` characters of consecutive lines, or one longer line.  Steps and lines
    may be as uneven as they like: the lines move once into balanced ranges, and kept lines once more into their
    pieces.  A NULL run is a run; NULL lines count as empty ones; lines that repeat a position stand in any
    order; an empty table gives no rows.  Runs jobs.
    """
    line = F.coalesce(F.col(line_col), F.lit(""))
    cut, alone = splitlines(F.concat(line, F.lit("\n"))), splitlines(line)
    physical = lines.select(F.col(run_col).alias("_run"), F.col(pos_col).alias("_pos"), F.posexplode(cut).alias("_sub", "_line"),
                            line.rlike(f"(?dU)^{A.STEP_DELIM_RE}").alias("_delim"), (F.size(alone)).alias("_n"))
    text = F.col("_line")
    flagged = physical.select(
        "_run", "_pos", "_sub", "_line", (F.col("_delim") & (F.col("_sub") == 0)).alias("_starts"), (F.col("_sub") >= F.col("_n")).alias("_rest"),
        A._event(text).alias("_ev"), A._is_border(text).alias("_border"), A._is_meta(text).alias("_meta"), (F.length(text) + 1).alias("_size"))
    rows = _stated(flagged, n_ranges, piece_chars)
    ev, state, plain = F.col("_ev"), F.col("_state"), (F.col("_ev") == A.NONE) & ~F.col("_meta")
    section = F.when(ev == A.WARN, _SECTIONS[A.WARN])
    for kind, name in _SECTIONS.items():
        section = section.when(plain & (state == kind), name)
    rows = rows.withColumn("_section", section)
    key = ["_run", "_step"]
    last_out = F.max_by("_line", F.when(ev == A.OUT, F.struct("_rng", "_row")))
    steps = rows.groupBy(*key).agg(last_out.alias("_out"), F.count("_section").alias("_kept"), F.count(F.lit(1)).alias("_lines"))
    out = py_strip(F.substring("_out", len(A.OUT_PREFIX) + 1, 2 ** 31 - 1))
    bare = (steps.where((F.col("_kept") == 0) & (F.col("_out").isNull() | (out == "")))
            .select(F.col("_run").alias("_r"), F.col("_step").alias("_s"), "_lines"))
    rest = (rows.join(bare, F.col("_run").eqNullSafe(F.col("_r")) & (F.col("_step") == F.col("_s")))
            .where(~F.col("_starts") | (F.col("_lines") == 1)).withColumn("_section", F.lit("raw_text")))
    columns = [*key, "_section", "_rng", "_chunk", "_row", "_line"]
    pieces = (rows.where(F.col("_section").isNotNull()).select(*columns).unionByName(rest.select(*columns))
              .groupBy(*key, "_section", "_rng", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_row", "_line"))).alias("_x"))
              .select(*key, "_section", (F.shiftleft(F.col("_rng").cast("long"), 40) + F.col("_chunk")).alias("piece"),
                      F.array_join("_x._line", "\n").alias("text")))
    outs = steps.where(F.col("_out").isNotNull()).select(*key, F.lit("out").alias("_section"), F.lit(0).cast("long").alias("piece"), out.alias("text"))
    return pieces.unionByName(outs).select(F.col("_run").alias(run_col), (F.col("_step") - 1).cast("int").alias("step_pos"),
                                           F.col("_section").alias("section"), "piece", "text")
