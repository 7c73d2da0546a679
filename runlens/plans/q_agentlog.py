"""Driver queries for agent logs (X3), status traces (Q3) and trace points (Q6).

Bridge B3: every conversation turn becomes one agent log; each paragraph of
its text (split on '\\n') becomes one step, whose shape is chosen by
``kind = (conv_id + turn + j) % 5`` (j = 0-based paragraph number):

  0  code block closed by a border with a leading space (border kept in code)
  1  code block closed by a border at line start
  2  execution logs (Maven markers for some steps) + ``Out: j``
  3  ``Warning to user: …``
  4  unstructured text followed by an empty ``Out:`` (raw text kept)

Meta line ``[Step j: Duration j.25 seconds| Input tokens: len*1000 | Output
tokens: turn]`` unless ``conv_id % 5 = 0``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import agentlog, trace
from runlens.plans import bridges as B
from runlens.plans.catalog import register
from runlens.plans.q_text import B2_MARKERS

BAR = "━" * 30
CODE_OPEN = " ─ Executing parsed code: " + "─" * 20 + " "
BORDER_SPACED = " " + "─" * 40 + " "
BORDER_PLAIN = "─" * 40
RUN_HEADER = "╭" + "─" * 20 + " New run " + "─" * 20 + "╮"
BLANK_FRAME = "│" + " " * 49 + "│"


def b3_agent_logs(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    header = F.concat_ws(
        "\n", F.lit(RUN_HEADER), F.lit(BLANK_FRAME),
        F.concat(F.lit("│ Conversation "), conv.cast("string"), F.lit(" turn "), turn.cast("string"),
                 F.lit(" by "), F.col("role"), F.lit("    │")),
        F.concat(F.lit("╰─ LiteLLMModel - bridge/"), F.col("role"), F.lit(" " + "─" * 10 + "╯")))

    def block(p, j):
        kind = (conv + turn + j) % 5
        mk = (conv + j) % 11
        marker = F.element_at(F.array(*[F.lit(m) for m in B2_MARKERS]), (mk + 1).cast("int"))
        maven = F.when((conv + j) % 3 != 0,
                       F.concat(F.lit("[INFO] Scanning for projects...\n[INFO] "), marker, F.lit("\n"), p)
                       ).otherwise(p)
        body = (F.when(kind == 0, F.concat_ws("\n", F.lit(CODE_OPEN), F.concat(F.lit("  "), p), F.lit(BORDER_SPACED)))
                .when(kind == 1, F.concat_ws("\n", F.lit(CODE_OPEN), F.concat(F.lit("  "), p), F.lit(BORDER_PLAIN)))
                .when(kind == 2, F.concat_ws("\n", F.lit("Execution logs:"), maven, F.lit(""),
                                             F.concat(F.lit("Out: "), j.cast("string"))))
                .when(kind == 3, F.concat(F.lit("Warning to user: "), p))
                .otherwise(F.concat(p, F.lit("\nOut:"))))
        meta = F.when(conv % 5 != 0, F.concat(
            F.lit("\n[Step "), j.cast("string"), F.lit(": Duration "), j.cast("string"),
            F.lit(".25 seconds| Input tokens: "), F.format_number(F.length(p) * 1000, 0),
            F.lit(" | Output tokens: "), turn.cast("string"), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(F.lit(BAR + " Step "), (j + 1).cast("string"), F.lit(" " + BAR + "\n"), body, meta,
                        F.lit("\n"))

    paras = F.split(F.col("text"), "\n", -1)
    log = F.concat(header, F.lit("\n"), F.array_join(F.transform(paras, block), ""))
    return c.select((conv * 100 + turn).alias("run_id"), log.alias("log"))


# Oracle pieces: one row per (conversation turn, paragraph).
_PARAS = """
WITH p AS (
  SELECT conv_id, turn, role, conv_id * 100 + turn AS run_id,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS j,
         unnest(string_split(text, chr(10))) AS p
  FROM conversations),
q AS (SELECT *, (conv_id + turn + j) % 5 AS kind, (conv_id + j) % 11 AS mk, (conv_id + j) % 3 <> 0 AS has_mvn,
             conv_id % 5 <> 0 AS has_meta FROM p)"""

_MARKERS_SQL = "[" + ", ".join("'" + m + "'" for m in B2_MARKERS) + "]"


_AGENT_STEPS_SQL = _PARAS + f"""
SELECT run_id, j AS step_pos, CAST(j + 1 AS INTEGER) AS header_step,
       '{RUN_HEADER}' AS run_header,
       'Conversation ' || CAST(conv_id AS VARCHAR) || ' turn ' || CAST(turn AS VARCHAR) || ' by ' || role AS description,
       'LiteLLMModel - bridge/' || role || ' {"─" * 10}╯' AS model_info,
       CASE kind WHEN 0 THEN p || chr(10) || '{BORDER_SPACED.rstrip()}' WHEN 1 THEN p END AS code,
       CASE WHEN kind = 3 THEN 'Warning to user: ' || p END AS warnings,
       CASE WHEN kind = 2 THEN
         CASE WHEN has_mvn THEN '[INFO] Scanning for projects...' || chr(10) || '[INFO] '
                                || {_MARKERS_SQL}[mk + 1] || chr(10) || p ELSE p END END AS execution_logs,
       CASE kind WHEN 2 THEN CAST(j AS VARCHAR) WHEN 4 THEN '' END AS out,
       CASE WHEN kind = 4 THEN p || chr(10) || 'Out:' ||
         CASE WHEN has_meta THEN chr(10) || '[Step ' || CAST(j AS VARCHAR) || ': Duration ' || CAST(j AS VARCHAR)
              || '.25 seconds| Input tokens: ' || format('{{:,}}', length(p) * 1000) || ' | Output tokens: '
              || CAST(turn AS VARCHAR) || ']' ELSE '' END END AS raw_text,
       CAST(CASE WHEN has_meta THEN j ELSE j + 1 END AS INTEGER) AS step_number,
       CASE WHEN has_meta THEN CAST(j AS DOUBLE) + 0.25 ELSE CAST(0 AS DOUBLE) END AS duration,
       CAST(CASE WHEN has_meta THEN length(p) * 1000 ELSE 0 END AS BIGINT) AS input_tokens,
       CAST(CASE WHEN has_meta THEN turn ELSE 0 END AS BIGINT) AS output_tokens
FROM q"""


@register("agent_steps", oracle=_AGENT_STEPS_SQL)
def q_agent_steps(spark, sf_dir):
    steps = agentlog.parse_agent_logs(b3_agent_logs(spark, sf_dir))
    return steps.select("run_id", "step_pos", "header_step", "run_header", "description", "model_info",
                        "code", "warnings", "execution_logs", "out", "raw_text", "meta.*")


def b3_agent_log_lines(spark, sf_dir):
    """B3 logs as lines (run_id, pos, line), the shape ``spark.read.text`` gives."""
    logs = b3_agent_logs(spark, sf_dir)
    return logs.select("run_id", F.posexplode(F.split("log", "\n", -1)).alias("pos", "line"))


def q_agent_steps_lines(spark, sf_dir):
    """X3 over logs held as lines (skew-safe step numbering); same answer as ``agent_steps``."""
    steps = agentlog.parse_agent_log_lines(b3_agent_log_lines(spark, sf_dir))
    return steps.select("run_id", "step_pos", "header_step", "run_header", "description", "model_info",
                        "code", "warnings", "execution_logs", "out", "raw_text", "meta.*")


@register("log_header", oracle="""
SELECT conv_id * 100 + turn AS run_id,
       'Conversation ' || CAST(conv_id AS VARCHAR) || ' turn ' || CAST(turn AS VARCHAR) || ' by ' || role AS description,
       'LiteLLMModel - bridge/' || role || ' """ + "─" * 10 + """╯' AS model_info,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_steps
FROM conversations""")
def q_log_header(spark, sf_dir):
    """header fields and step count per log (logs without steps kept)."""
    h = agentlog.parse_log_headers(b3_agent_logs(spark, sf_dir))
    return h.select("run_id", "description", "model_info", "n_steps")


# Status code of a B3 step's execution log, by marker index (10 = no marker -> UNKNOWN).
_MK_CODE = "CASE mk WHEN 0 THEN 9 WHEN 1 THEN 9 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 10 WHEN 5 THEN 3 " \
           "WHEN 6 THEN 2 WHEN 7 THEN 8 WHEN 8 THEN 7 WHEN 9 THEN 5 ELSE 6 END"
_NAME = "CASE c " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in [
    (1, "COMPILE_ERROR"), (2, "TESTS_STARTED"), (3, "SUCCESS"), (4, "DEPENDENCY_ERROR"), (5, "UNKNOWN_ERROR"),
    (6, "UNKNOWN"), (7, "GOAL_ERROR"), (8, "PLUGIN_RESOLVE_ERROR"), (9, "INVALID_POM"), (10, "SKIPPED_TESTS")]) + " END"
_TRACE_SQL = _PARAS + f""",
t AS (SELECT run_id, j AS step, {_MK_CODE} AS c FROM q WHERE kind = 2 AND has_mvn)"""


@register("status_trace", oracle=_TRACE_SQL + f"""
SELECT run_id, step, c AS status_code, {_NAME} AS status_name FROM t""")
def q_status_trace(spark, sf_dir):
    """Q3 over B3 logs."""
    return trace.status_trace(agentlog.parse_agent_logs(b3_agent_logs(spark, sf_dir), fields=("execution_logs",)))


@register("trace_points", oracle=_TRACE_SQL + f"""
SELECT run_id, step,
       CAST((SELECT count(DISTINCT t2.c) FROM t t2 WHERE t2.run_id = t.run_id AND t2.c < t.c) AS INTEGER) AS y,
       c AS status_code, {_NAME} || ' (' || CAST(c AS VARCHAR) || ')' AS label
FROM t""")
def q_trace_points(spark, sf_dir):
    """Q6: (step, rank of status among the run's distinct statuses, label)."""
    return trace.trace_points(q_status_trace(spark, sf_dir))


@register("distinct_statuses", oracle=_TRACE_SQL + f"""
SELECT DISTINCT run_id, c AS status_code, {_NAME} AS status_name FROM t""")
def q_distinct_statuses(spark, sf_dir):
    """A8 + L2: the distinct statuses of each trace, in enum order."""
    return trace.distinct_statuses(q_status_trace(spark, sf_dir))


@register("experiment_data", oracle="""
WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 11 <> 0 AS has_result,
                  CASE WHEN o_orderkey % 11 <> 0 THEN NOT (o_orderkey % 7 IN (0, 1, 2)) END AS build_success
           FROM orders),
h AS (SELECT conv_id * 100 + turn AS run_id,
             'Conversation ' || CAST(conv_id AS VARCHAR) || ' turn ' || CAST(turn AS VARCHAR) || ' by ' || role
               AS description,
             CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_steps FROM conversations),
f AS (SELECT p_partkey AS run_id, p_size AS number_of_modules, p_brand AS license FROM part)
SELECT r.run_id, has_result, build_success, description, n_steps, number_of_modules, license
FROM r LEFT JOIN h ON h.run_id = r.run_id LEFT JOIN f ON f.run_id = r.run_id""")
def q_experiment_data(spark, sf_dir):
    """Build results, agent-log headers and repository features per run (each optional)."""
    from runlens.operators import runs
    from runlens.plans.q_builds import verdicts
    art = verdicts(spark, sf_dir).select("run_id", "has_result", "build_success")
    heads = agentlog.parse_log_headers(b3_agent_logs(spark, sf_dir)).select("run_id", "description", "n_steps")
    feats = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run_id"),
                                                  F.col("p_size").alias("number_of_modules"),
                                                  F.col("p_brand").alias("license"))
    return runs.experiment_data(art, heads, feats, key="run_id")


register("agent_steps_lines", oracle=_AGENT_STEPS_SQL)(q_agent_steps_lines)


@register("agent_steps_files", oracle=_AGENT_STEPS_SQL)
def q_agent_steps_files(spark, sf_dir):
    """X3 over log files: every log is written as ``stdout.log`` of its own run folder in one of two experiments, the folders
    are listed and the files read as lines; same answer as ``agent_steps``.  Writes its files at the time of the call."""
    from runlens.sources import files as S
    run = F.col("run_id")
    rel = F.concat(F.lit("exp"), (run % 2).cast("string"), F.lit("/job_results/own_r"), run.cast("string"), F.lit("/stdout.log"))
    root = B.files_written(b3_agent_logs(spark, sf_dir).select(rel.alias("rel"), F.col("log").alias("content")), "agent-logs")
    steps = agentlog.parse_agent_log_lines(S.read_agent_log_lines(spark, root))
    return steps.select(F.regexp_extract("run_id", "own_r([0-9]+)$", 1).cast("bigint").alias("run_id"), "step_pos", "header_step", "run_header",
                        "description", "model_info", "code", "warnings", "execution_logs", "out", "raw_text", "meta.*")


_B3_SECTIONS = f"""
SELECT run_id, j AS step_pos, 'code' AS section, '  ' || p AS line FROM q WHERE kind IN (0, 1)
UNION ALL SELECT run_id, j, 'code', '{BORDER_SPACED}' FROM q WHERE kind = 0
UNION ALL SELECT run_id, j, 'warnings', 'Warning to user: ' || p FROM q WHERE kind = 3
UNION ALL SELECT run_id, j, 'execution_logs', unnest(CASE WHEN has_mvn
    THEN ['[INFO] Scanning for projects...', '[INFO] ' || {_MARKERS_SQL}[mk + 1], p, ''] ELSE [p, ''] END) FROM q WHERE kind = 2
UNION ALL SELECT run_id, j, 'out', CASE kind WHEN 2 THEN CAST(j AS VARCHAR) ELSE '' END FROM q WHERE kind IN (2, 4)
UNION ALL SELECT run_id, j, 'raw_text', unnest([p, 'Out:']) FROM q WHERE kind = 4
UNION ALL SELECT run_id, j, 'raw_text', '[Step ' || CAST(j AS VARCHAR) || ': Duration ' || CAST(j AS VARCHAR)
    || '.25 seconds| Input tokens: ' || format('{{:,}}', length(p) * 1000) || ' | Output tokens: ' || CAST(turn AS VARCHAR) || ']'
  FROM q WHERE kind = 4 AND has_meta"""


@register("agent_step_pieces", oracle=_PARAS + _B3_SECTIONS)
def q_agent_step_pieces(spark, sf_dir):
    """X3 in pieces: the lines of every section of every step, from its pieces.  Writes its lines at the time of the call."""
    from runlens.operators.agentpieces import agent_step_pieces
    pieces = agent_step_pieces(b3_agent_log_lines(spark, sf_dir), piece_chars=4096)
    return pieces.select("run_id", "step_pos", "section", F.explode(F.split("text", "\n", -1)).alias("line"))
