"""Agent-log parser: an own sample, edge cases, and random logs written from their expected sections."""
import random

import pytest

from runlens.operators import agentlog, trace

BAR = "━" * 12


def parse(spark, logs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(logs)], "run_id long, log string")
    return sorted(agentlog.parse_agent_logs(df).collect(), key=lambda r: (r.run_id, r.step_pos))


# A run that never reads a file: it lists tools, is interrupted, and reports a number.
SAMPLE = "\n".join([
    "console opened",
    "=== New run #42 ===",
    "│ Count the modules that still need work │",
    "╰─ LiteLLMModel - lab/tester ╯",
    f"{BAR} Step 4 {BAR}",
    "Execution logs:",
    "found 3 modules",
    "",
    "two of them are old",
    "[Step 9: Duration 0.75 seconds| Input tokens: 12 | Output tokens: 1,024]",
    f"{BAR} Step 5 {BAR}",
    "nothing was written here",
    f"{BAR} Step 6 {BAR}",
    "Warning to user: interrupted",
    "─ Executing parsed code: ─",
    "count = 2",
    "────",
    "Out:   2  ",
])


def test_own_sample(spark):
    logs, plain, last = parse(spark, [SAMPLE])
    assert {(r.run_header, r.description, r.model_info) for r in (logs, plain, last)} == {
        ("=== New run #42 ===", "console opened", "LiteLLMModel - lab/tester ╯")}
    assert [r.header_step for r in (logs, plain, last)] == [4, 5, 6]
    assert logs.execution_logs == "found 3 modules\n\ntwo of them are old"
    assert tuple(logs.meta) == (9, 0.75, 12, 1024) and logs.raw_text is None
    assert plain.raw_text == "nothing was written here" and tuple(plain.meta) == (5, 0.0, 0, 0)
    assert (last.warnings, last.code, last.out) == ("Warning to user: interrupted", "count = 2", "2")


def test_no_delimiter_no_steps(spark):
    assert parse(spark, ["just some text\nNew run\n"]) == []
    df = spark.createDataFrame([(0, "│ hello │\nNew run here")], "run_id long, log string")
    h = agentlog.parse_log_headers(df).collect()[0]
    assert (h.n_steps, h.run_header, h.description) == (0, "New run here", "hello")


def test_missing_meta_defaults_and_raw_text(spark):
    (s,) = parse(spark, [f"{BAR} Step 7 {BAR}\nsomething failed\n  badly  \n"])
    assert (s.meta.step_number, s.meta.duration, s.meta.input_tokens, s.meta.output_tokens) == (7, 0.0, 0, 0)
    assert s.raw_text == "something failed\n  badly"


def test_empty_out_keeps_raw_text(spark):
    (s,) = parse(spark, [f"{BAR} Step 1 {BAR}\nnote\nOut:\n"])
    assert s.out == "" and s.raw_text == "note\nOut:"


def test_border_at_line_start_closes_code(spark):
    (s,) = parse(spark, [f"{BAR} Step 1 {BAR}\n ─ Executing parsed code: ──\n  a()\n─────\nafter\n"])
    assert s.code == "a()"


def test_last_step_number_on_delimiter_counts(spark):
    (s,) = parse(spark, [f"{BAR} Step 1 Step 22 {BAR}\nx\n"])
    assert s.header_step == 22


def test_crlf_lines(spark):
    (s,) = parse(spark, [f"{BAR} Step 1 {BAR}\r\nExecution logs:\r\nline a\r\nOut: 5\r\n"])
    assert s.execution_logs == "line a" and s.out == "5"


def test_trace_positions_and_ranks(spark):
    log = "\n".join([
        f"{BAR} Step 1 {BAR}", "Execution logs:", "Scanning for projects", "BUILD SUCCESS", "Out: a",
        f"{BAR} Step 2 {BAR}", "no logs here",
        f"{BAR} Step 3 {BAR}", "Execution logs:", "Scanning for projects", "COMPILATION ERROR",
        f"{BAR} Step 4 {BAR}", "Execution logs:", "plain output",
        f"{BAR} Step 5 {BAR}", "Execution logs:", "Scanning for projects", "BUILD SUCCESS"])
    df = spark.createDataFrame([(1, log)], "run_id long, log string")
    t = trace.status_trace(agentlog.parse_agent_logs(df))
    pts = sorted((r.step, r.y, r.label) for r in trace.trace_points(t).collect())
    assert pts == [(0, 1, "SUCCESS (3)"), (2, 0, "COMPILE_ERROR (1)"), (4, 1, "SUCCESS (3)")]


# --------------------------------------------------------------------------
# Random logs written from the expected answer: a step is a list of blocks, and every block says what it
# adds to which section, so no parser is needed to know the result.
def _words(r, n=3):
    return [r.choice(["alpha", "  beta gamma", "BUILD SUCCESS", "", "x = [1, 2]", "a ─ b"]) for _ in range(r.randint(1, n))]


def _code_block(r):
    body = _words(r)
    closed = r.random() < 0.5
    return [" " + agentlog.CODE_MARKER + "──", *body, *(["─" * r.randint(1, 9), "outside any section"] if closed else [])], {"code": body}


def _warning_block(r):
    body = [agentlog.WARN_PREFIX + " mind this", *_words(r)]
    return body, {"warnings": body}


def _logs_block(r):
    body = _words(r)
    return [agentlog.LOGS_PREFIX, *body], {"logs": body}


def _out_block(r):
    value = r.choice(["None", "42", "[1, 2]"])
    return [f"{agentlog.OUT_PREFIX}  {value} ", *r.choice([[], ["behind the output"]])], {"out": value}


def _meta_block(r):
    n, i, o = r.randint(0, 9), r.randint(1, 9), r.randint(0, 999)
    return [f"[Step {n}: Duration {i}.5 seconds| Input tokens: {i},{o:03d} | Output tokens: {o}]"], {"meta": (n, i + 0.5, i * 1000 + o, o)}


def _written_step(r):
    """(lines of a step, expected row)."""
    number = r.randint(1, 60)
    lines, added = [f"{BAR} Step {number} {BAR}"], {"code": [], "warnings": [], "logs": []}
    out, meta = None, (number, 0.0, 0, 0)
    free = _words(r) if r.random() < 0.4 else []
    lines += free
    for _ in range(r.randint(0, 5)):
        block, says = r.choice([_code_block, _warning_block, _logs_block, _out_block, _meta_block])(r)
        lines += block
        for name, value in says.items():
            if name in added:
                added[name] += value
            elif name == "out":
                out = value
            else:
                meta = value
    sections = {k: "\n".join(v).strip() if v else None for k, v in added.items()}
    raw = None
    if out is None and not any(added.values()):
        raw = "\n".join(lines[1:]).strip() if len(lines) > 1 else lines[0]
    return lines, (number, sections["code"], sections["warnings"], sections["logs"], out, raw, meta)


def _written_log(r):
    """(log, expected steps).  A meta line never stands alone in an unstructured step of the sample."""
    steps = [_written_step(r) for _ in range(r.randint(0, 6))]
    lines = [r.choice(["header", "New run", "│ describe │"]), *(x for s, _ in steps for x in s)]
    return "\n".join(lines) + "\n", [want for _, want in steps]


def _random_log(r):
    return _written_log(r)[0]


def test_random_logs_give_what_they_were_written_from(spark):
    r = random.Random(7)
    written = [_written_log(r) for _ in range(300)]
    got = parse(spark, [log for log, _ in written])
    want = [(i, n, s) for i, (_, steps) in enumerate(written) for n, s in enumerate(steps)]
    assert len(got) == len(want) > 300
    for row, (i, n, s) in zip(got, want):
        mine = (row.header_step, row.code, row.warnings, row.execution_logs, row.out, row.raw_text, tuple(row.meta))
        assert (row.run_id, row.step_pos, mine) == (i, n, s), written[i][0]


def test_line_form_matches_in_row_form(spark):
    from pyspark.sql import functions as F
    r = random.Random(11)
    logs = [_random_log(r) for _ in range(150)]
    # One hot run holding most of the lines, to exercise several ranges of one run.
    logs.append("\n".join(f"{BAR} Step {i} {BAR}\nExecution logs:\nline {i}\nOut: {i}" for i in range(1, 400)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(logs)], "run_id long, log string")
    lines = df.select("run_id", F.posexplode(F.split("log", "\n", -1)).alias("pos", "line"))
    cols = ["run_id", "step_pos", "header_step", "run_header", "description", "model_info", "code", "warnings",
            "execution_logs", "out", "raw_text", "meta"]
    a = sorted(tuple(x) for x in agentlog.parse_agent_logs(df).select(*cols).collect())
    b = sorted(tuple(x) for x in agentlog.parse_agent_log_lines(lines, n_ranges=8).select(*cols).collect())
    assert a == b


def test_line_functions_compose():
    from runlens.operators.agentpieces import CLOSE, SAME, then
    apply = lambda fn, kind: kind if fn == SAME else (agentlog.NONE if kind == agentlog.CODE else kind) if fn == CLOSE else fn
    every = [SAME, CLOSE, *range(5)]
    for a in every:
        for b in every:
            assert all(apply(then(a, b), kind) == apply(b, apply(a, kind)) for kind in range(5))
            assert all(then(then(a, b), c) == then(a, then(b, c)) for c in every)


@pytest.mark.parametrize("n_ranges, piece_chars", [(1, 1 << 20), (9, 40), (40, 1)])
def test_pieces_joined_are_the_sections(spark, n_ranges, piece_chars):
    from pyspark.sql import functions as F
    from runlens.operators.agentpieces import agent_step_pieces
    r = random.Random(5)
    logs = [_random_log(r) for _ in range(60)]
    step = f"{BAR} Step 1 {BAR}"
    # Ends of logs, borders in and out of code, unusual line breaks, steps with nothing in them.
    logs += ["", "no step", step, step + "\n", f"{step}\nExecution logs:", f"{step}\nExecution logs:\n", f"{step}\nExecution logs:\n\n",
             f"{step}\nExecution logs:\n\x0b", f"{step}\nWarning to user: a\x0bb\r\nc\r", f"{step}\n{'─' * 9}\nleft", f"{step}\nOut: 1\nOut:\nrest",
             f"{step}\n ─ Executing parsed code: ──\nx\n{'─' * 9}\ny\nExecution logs:\n{'─' * 9}\nz\n{step}\n{step}\n\n"]
    # One step with most of all lines, whose code and logs go on over many ranges.
    logs.append("\n".join(["head", step, " ─ Executing parsed code: ──", *(f"x{i}" for i in range(700)), "─" * 20, *(f"no {i}" for i in range(300)),
                           "Execution logs:", *(f"log {i}" for i in range(900)), f"{BAR} Step 2 {BAR}", *(f"free {i}" for i in range(500))]))
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(logs)], "run_id long, log string")
    lines = df.select("run_id", F.posexplode(F.split("log", "\n", -1)).alias("pos", "line"))
    pieces = agent_step_pieces(lines, n_ranges=n_ranges, piece_chars=piece_chars)
    got = {}
    for p in sorted(pieces.collect(), key=lambda p: p.piece):
        got.setdefault((p.run_id, p.step_pos, p.section), []).append(p.text)
    names = ("code", "warnings", "execution_logs", "out", "raw_text")
    want = {(s.run_id, s.step_pos, n): s[n] for s in agentlog.parse_agent_logs(df).collect() for n in names if s[n] is not None}
    assert {k: "\n".join(v).strip() for k, v in got.items()} == want
    if n_ranges > 1:
        assert len(got[len(logs) - 1, 0, "execution_logs"]) > 3 and len(got[len(logs) - 1, 1, "raw_text"]) > 1


def test_pieces_of_an_empty_table(spark):
    from runlens.operators.agentpieces import agent_step_pieces
    none = spark.createDataFrame([], "run_id long, pos int, line string")
    assert agent_step_pieces(none).collect() == []
    one = spark.createDataFrame([(1, 0, f"{BAR} Step 1 {BAR}"), (1, 1, None), (1, 2, "x")], "run_id long, pos int, line string")
    assert [tuple(p)[:3] + (p.text,) for p in agent_step_pieces(one, n_ranges=1).collect()] == [(1, 0, "raw_text", "\nx")]
