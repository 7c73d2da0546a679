"""Agent console logs -> steps (X3 = W1, W2, A9-A11, F11, F23, F24).

Design: a log is one row (one file).  Everything happens *inside the row*
with Spark's higher-order array functions, then ``posexplode`` emits one
row per step.  There is no shuffle and no window: a run with a million steps
is still split across tasks by the explode, and no key can pile up in one
partition.

Per step, the reference's line state machine is restated as segments:
hard events (code marker, ``Warning to user:``, ``Execution logs:``,
``Out:``) start a segment; a border line (starts with ``─``, only ``─`` and
spaces) closes a *code* segment and is ignored elsewhere; meta lines
(``[Step n: …``) are never kept.  A segment's kind is the event of its first
line, so every line's state is known without carrying state line to line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators._plan import evaluate_once
from runlens.functions.text import PY_SPACE, py_strip, py_strip_chars, splitlines

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Step delimiter: a line of '━' that names "Step <n>" (the last "Step n" on the
# line counts, since the leading '.*' is greedy); '\n' is the only line end.
STEP_DELIM_RE = "━+.*Step\\s+(\\d+)"
CODE_MARKER = "─ Executing parsed code:"
WARN_PREFIX = "Warning to user:"
LOGS_PREFIX = "Execution logs:"
OUT_PREFIX = "Out:"
META_START_RE = "^\\[Step\\s+\\d+:"
META_RE = ("\\[Step\\s+(\\d+): Duration ([\\d\\.]+) seconds\\| Input tokens: ([\\d,]+) "
           "\\| Output tokens: ([\\d,]+)\\]")
RUN_HEADER_MARKER = "New run"
MODEL_MARKER = "LiteLLMModel"
BORDER_CHAR = "─"
DESCRIPTION_FRAME = "│"
MODEL_FRAME = "╰─"
# ---------------------------------------------------------------------------

# Segment kinds (event of a segment's first line).
NONE, CODE, WARN, LOGS, OUT = 0, 1, 2, 3, 4

def _empty() -> Column:
    return F.array().cast("array<string>")


def _at(arr: Column, i) -> Column:
    """1-based element (negative from the end); NULL when out of range."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(i))


def _event(line: Column) -> Column:
    return (F.when(line.contains(CODE_MARKER), F.lit(CODE))
            .when(line.startswith(WARN_PREFIX), F.lit(WARN))
            .when(line.startswith(LOGS_PREFIX), F.lit(LOGS))
            .when(line.startswith(OUT_PREFIX), F.lit(OUT))
            .otherwise(F.lit(NONE)))


def _is_border(line: Column) -> Column:
    return line.startswith(BORDER_CHAR) & line.rlike(f"(?U)^{BORDER_CHAR}[{BORDER_CHAR} ]*{PY_SPACE}*$")


def _is_meta(line: Column) -> Column:
    return line.startswith("[Step") & line.rlike(f"(?U){META_START_RE}")


def _joined(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, py_strip(F.array_join(arr, "\n")))


def _header_fields(lines: Column) -> list[Column]:
    run_header = _at(F.filter(lines, lambda l: l.contains(RUN_HEADER_MARKER)), 1)
    framed = F.transform(lines, lambda l: py_strip(py_strip_chars(l, DESCRIPTION_FRAME)))
    desc = _at(F.filter(framed, lambda s: (s != "") & ~s.contains(RUN_HEADER_MARKER)
                        & ~s.contains(BORDER_CHAR) & ~s.contains(MODEL_MARKER)), 1)
    model = _at(F.filter(lines, lambda l: l.contains(MODEL_MARKER)), 1)
    return [py_strip(run_header).alias("run_header"), desc.alias("description"),
            py_strip(py_strip_chars(model, MODEL_FRAME)).alias("model_info")]


def _pieces(df: DataFrame, log_col: str) -> DataFrame:
    """Cut at delimiter lines once; header text, step texts (in order) and their count."""
    other = [c for c in df.columns if c != log_col]
    cut = evaluate_once(df.select(*other, F.split(F.col(log_col), f"(?dmU)^(?={STEP_DELIM_RE})", -1).alias("_p")))
    pieces = F.col("_p")
    starts_with_step = _at(pieces, 1).rlike(f"(?dU)^{STEP_DELIM_RE}")
    header = F.when(starts_with_step, F.lit("")).otherwise(_at(pieces, 1))
    steps = F.when(starts_with_step, pieces).otherwise(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))))
    staged = evaluate_once(cut.select(*other, header.alias("_header"), steps.alias("_steps")))
    return evaluate_once(staged.select(*other, splitlines(F.col("_header")).alias("_hlines"), "_steps"))


def split_steps(df: DataFrame, log_col: str = "log") -> DataFrame:
    """Cut each log at delimiter lines; keep header columns; one row per step.

    Adds ``step_pos`` (0-based position among all steps, W3) and ``step_text``.
    Logs without a delimiter produce no step rows (see ``parse_log_headers``).
    Every intermediate array is built once per row (``evaluate_once`` keeps
    Catalyst from inlining it into each consumer).
    """
    other = [c for c in df.columns if c != log_col]
    staged = _pieces(df, log_col)
    return staged.select(*other, *_header_fields(F.col("_hlines")),
                         F.posexplode("_steps").alias("step_pos", "step_text"))


#: What ``parse_steps`` can build; the raw text needs all sections.
FIELDS = ("code", "warnings", "execution_logs", "out", "raw_text", "meta")


def parse_steps(steps: DataFrame, text_col: str = "step_text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Sections, output, meta and raw text of each step row.

    ``fields`` names the columns that are built (the evaluate-once stages below would keep Catalyst
    from dropping unused ones).  The step's text is not carried further.
    """
    need = set(FIELDS) - {"meta"} if "raw_text" in fields else set(fields)
    t = F.col(text_col)
    other = [c for c in steps.columns if c != text_col]
    keep = [F.col(c) for c in other]
    alone = [F.col("_alone")] if "raw_text" in fields else []
    s1 = evaluate_once(steps.select(*keep, splitlines(t).alias("_lines"), F.regexp_extract(t, f"(?dU)^{STEP_DELIM_RE}", 1)
                                    .try_cast("int").alias("header_step"),
                                    *([py_strip(F.when(F.size(splitlines(t)) <= 1, t)).alias("_alone")] if alone else [])))
    lines = F.col("_lines")
    n = F.size(lines)
    # What an event line opens is read once per line; a lambda's shared parts are not, so they come as arrays.
    s2 = evaluate_once(s1.select("*", F.transform(lines, _event).alias("_ev"), F.transform(lines, _is_border).alias("_border"),
                                 F.transform(lines, _is_meta).alias("_metas")))
    ev = F.col("_ev")
    # Segment starts: line 1 (state NONE unless it is itself an event) and every event line.
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(idx, lambda i: (i == 1) | (_at(ev, i) > 0))
    s3 = evaluate_once(s2.withColumn("_starts", starts))
    st = F.col("_starts")

    def bounds(s, j):
        """(kind, first line of the body, last line) of a segment; a border line ends a code body."""
        end = F.when(j + 1 < F.size(st), _at(st, j + 2) - 1).otherwise(n)
        kind = _at(ev, s)
        border = F.array_position(F.slice(F.col("_border"), s + 1, F.greatest(end - s, F.lit(0))), True)
        return F.struct(kind.alias("kind"), F.when(kind == WARN, s).otherwise(s + 1).alias("first"),
                        F.when((kind == CODE) & (border > 0), s + border.cast("int") - 1).otherwise(end).alias("last"))

    s4 = evaluate_once(s3.withColumn("_segs", F.transform(st, bounds)))
    segs = F.col("_segs")

    def section(kind):
        """Lines kept for one section kind, in order; meta lines never count."""
        own = F.filter(segs, lambda s: (s["kind"] == kind) & (s["last"] >= s["first"]))
        places = F.flatten(F.transform(own, lambda s: F.sequence(s["first"], s["last"])))
        return F.transform(F.filter(places, lambda i: ~_at(F.col("_metas"), i)), lambda i: _at(lines, i))

    sections = {"code": CODE, "warnings": WARN, "execution_logs": LOGS}
    outs = F.filter(segs, lambda s: s["kind"] == OUT)
    # A meta line only counts when no earlier rule consumed it (the code marker wins).
    meta_line = _at(F.filter(lines, lambda l: _is_meta(l) & ~l.contains(CODE_MARKER)
                                      & l.rlike(f"(?U){META_RE}")), -1)
    s5 = evaluate_once(s4.select(
        *keep, "header_step", *alone,
        *([F.when(n > 1, F.array_join(F.slice(lines, 2, n - 1), "\n")).alias("_rest")] if alone else []),
        *[section(k).alias(f"_{name}") for name, k in sections.items() if name in need],
        *([_at(lines, _at(outs, -1)["first"] - 1).alias("_out")] if "out" in need else []),
        *([meta_line.alias("_meta")] if "meta" in fields else [])))
    meta = F.col("_meta")

    def g(i):
        return F.regexp_extract(meta, f"(?U){META_RE}", i)

    has_meta = meta.isNotNull()
    meta_struct = F.struct(
        F.when(has_meta, g(1).try_cast("int")).otherwise(F.col("header_step")).alias("step_number"),
        F.when(has_meta, g(2).try_cast("double")).otherwise(F.lit(0.0)).alias("duration"),
        F.when(has_meta, F.replace(g(3), F.lit(","), F.lit("")).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        .alias("input_tokens"),
        F.when(has_meta, F.replace(g(4), F.lit(","), F.lit("")).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        .alias("output_tokens"),
    )
    text = F.col("_out")
    out = py_strip(F.substring(text, F.lit(len(OUT_PREFIX) + 1), F.length(text)))
    built = {**{name: _joined(F.col(f"_{name}")) for name in sections if name in fields}, "out": out, "meta": meta_struct}
    if "raw_text" in fields:
        nothing = ((F.size("_code") == 0) & (F.size("_warnings") == 0) & (F.size("_execution_logs") == 0)
                   & (text.isNull() | (out == "")))
        built["raw_text"] = F.when(nothing, F.coalesce(py_strip(F.col("_rest")), F.col("_alone")))
    return evaluate_once(s5.select(*keep, "header_step", *[built[f].alias(f) for f in FIELDS if f in fields]))


def parse_agent_logs(df: DataFrame, log_col: str = "log", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(…, log) -> one row per step with header and the wanted fields (sections, output, meta, raw text)."""
    return parse_steps(split_steps(df, log_col), fields=fields)


def parse_log_headers(df: DataFrame, log_col: str = "log") -> DataFrame:
    """One row per log: header fields and the number of steps (logs without steps included)."""
    other = [c for c in df.columns if c != log_col]
    staged = _pieces(df, log_col)
    return staged.select(*other, *_header_fields(F.col("_hlines")), F.size("_steps").alias("n_steps"))


def parse_agent_log_lines(lines: DataFrame, run_col: str = "run_id", pos_col: str = "pos",
                          line_col: str = "line", n_ranges: int | None = None) -> DataFrame:
    """X3 for logs held as lines ``(run, position, line)``, e.g. read with ``spark.read.text``.

    The in-row parser keeps a whole log in one row, so one enormous log stays
    in one task.  Here the lines move once into ranges of (run, position) and
    get their step number, the running count of delimiter lines
    (``running_sum``, which writes them once), so a run holding a third of all
    lines is spread over many tasks.  Each step's lines are then joined into
    its text, one group per (run, step), and parsed by ``parse_steps``; a step
    is the unit the output describes (its sections are strings).  Header fields
    are the first matching lines before the first delimiter, an aggregate
    without a gather, joined on the run key.  Delimiters are recognised per line.
    """
    from runlens.operators._plan import running_sum
    flagged = lines.select(F.col(run_col).alias("_run"), F.col(pos_col).alias("_pos"), F.col(line_col).alias("_line"),
                           F.col(line_col).rlike(f"(?dU)^{STEP_DELIM_RE}").cast("bigint").alias("_d"))
    numbered = running_sum(flagged, ["_run"], ["_pos"], "_d", "_step", inclusive=True, n_ranges=n_ranges)
    # A step's text runs up to the next delimiter, so every step but the run's last ends with a line
    # break (it matters to splitlines when the last line is empty): a delimiter line tells the step before.
    told = numbered.where("_step > 0").select("_run", F.explode(F.array(
        F.struct("_step", F.struct(F.col("_pos").alias("p"), F.col("_line").alias("l")).alias("_x"), F.lit(False).alias("_more")),
        F.when(F.col("_d") == 1, F.struct((F.col("_step") - 1).alias("_step"), F.lit(None).alias("_x"), F.lit(True).alias("_more")))
    )).alias("t")).where("t is not null and t._step > 0").select("_run", "t.*")
    texts = told.groupBy("_run", "_step").agg(F.array_sort(F.collect_list("_x")).alias("_xs"), F.bool_or("_more").alias("_more"))
    steps = texts.select("_run", (F.col("_step") - 1).cast("int").alias("step_pos"), F.concat(
        F.array_join(F.transform("_xs", lambda x: x["l"]), "\n"), F.when(F.col("_more"), "\n").otherwise("")).alias("step_text"))
    head = (numbered.where("_step = 0").select("_run", "_pos", F.posexplode(splitlines(F.col("_line"))).alias("_sub", "_l")))
    place = F.struct("_pos", "_sub")
    framed = py_strip(py_strip_chars(F.col("_l"), DESCRIPTION_FRAME))
    described = ((framed != "") & ~framed.contains(RUN_HEADER_MARKER) & ~framed.contains(BORDER_CHAR) & ~framed.contains(MODEL_MARKER))
    headers = head.groupBy("_run").agg(
        py_strip(F.min_by("_l", F.when(F.col("_l").contains(RUN_HEADER_MARKER), place))).alias("run_header"),
        F.min_by(framed, F.when(described, place)).alias("description"),
        py_strip(py_strip_chars(F.min_by("_l", F.when(F.col("_l").contains(MODEL_MARKER), place)), MODEL_FRAME)).alias("model_info"))
    headers = headers.withColumnRenamed("_run", "_owner")
    return (parse_steps(steps).join(headers, F.col("_run").eqNullSafe(F.col("_owner")), "left").drop("_owner")
            .withColumnRenamed("_run", run_col))
