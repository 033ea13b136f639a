"""Hand-written session transcripts as JSON lines: one session for each thing that a reader or a detector must see.

A script is a list of turns: what the user states, what the agent thinks, says and calls, and what comes back. build()
puts each on a line of its own, with a clock of ten seconds a line. Lines of other shapes are written as they are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

PARSER = "1\tdef parse(text):\n2\t    return text.split(',')"
NOTES = "The totals are wrong because the rounding happens before the sum and not after it."


def call(key: str, name: str, **given: object) -> tuple:
    return ("call", key, name, given)


def shell(key: str, command: str) -> tuple:
    return call(key, "Bash", command=command)


def back(key: str, text: str) -> tuple:
    return ("result", key, text)


def edit(key: str, path: str, old: str = "a", new: str = "b") -> list[tuple]:
    return [call(key, "Edit", file_path=path, old_string=old, new_string=new), back(key, f"The file {path} has been updated.")]


def read(key: str, path: str, text: str) -> list[tuple]:
    return [call(key, "Read", file_path=path), back(key, text)]


def run(key: str, command: str, text: str) -> list[tuple]:
    return [shell(key, command), back(key, text)]


SCRIPTS: dict[str, list[tuple]] = {
    "rereads": [
        ("user", "Find where the parser drops trailing commas and fix it."),
        *read("r1", "src/parser.py", PARSER), call("g1", "Grep", pattern="comma", path="src"), back("g1", "src/parser.py:2"),
        *read("r2", "src/parser.py", PARSER), *read("r3", "src/parser.py", PARSER), call("g2", "Grep", path="src", pattern="comma"), back("g2", "src/parser.py:2"),
        *read("p1", "docs/shot.png", ""), *read("p2", "docs/shot.png", ""), *read("m1", "src/main.py", "import sys"),
        *edit("e1", "src/parser.py"), *read("r4", "src/parser.py", PARSER.replace(",", ";")), call("g3", "Grep", pattern="comma", path="src"), back("g3", "src/parser.py:2"),
        *run("c1", "pytest -q", "3 passed in 0.51s"), ("say", "The parser in parser.py keeps trailing commas now."),
    ],
    "rework": [
        ("user", "Make the totals test pass."), *read("r1", "src/totals.py", "def total(rows):\n    return sum(rows)"),
        *edit("e1", "src/totals.py"), *run("c1", "pytest -q tests/test_totals.py", "FAILED test_sum\n1 failed in 0.20s"),
        *edit("e2", "src/totals.py"), *run("c2", "pytest -q tests/test_totals.py", "FAILED test_sum\n1 failed in 0.31s"),
        *edit("e3", "src/totals.py"), *run("c3", "pytest -q tests/test_totals.py", "FAILED test_sum\n1 failed in 0.29s"),
        *edit("e4", "src/totals.py"), *run("c4", "pytest -q tests/test_totals.py", "FAILED test_round\n1 failed in 0.29s"),
        *edit("e5", "src/totals.py"), *run("c5", "pytest -q tests/test_totals.py", "2 passed in 0.29s"), ("say", "The totals test passes."),
    ],
    "repeats": [
        ("user", "Check the service and list what runs."), *run("a1", "systemctl list-units", "web.service"), *run("a2", "systemctl list-units", "web.service"),
        *edit("e1", "ops/web.conf"), *run("a3", "systemctl list-units", "web.service"), *run("b1", "make  test", "5 passed"), *run("b2", "make  test", "5 passed"),
        *run("s1", "sleep 5", ""), *run("s2", "sleep 5", ""), *run("d1", "date", "10:00"), *run("d2", "date", "10:01"), shell("o1", "uptime"), shell("o2", "uptime"), back("o2", "up 3 days"),
        *run("k1", "ruff check .", "All checks passed"), *run("k2", "git stash", "Saved"), *run("k3", "ruff check .", "All checks passed"),
        ("say", "All is well."), ("user", "And again, please."), *run("a4", "systemctl list-units", "web.service"), ("say", "Still well."),
    ],
    "fragments": [
        ("user", "Rename the fields of the record type."), *[t for k in range(5) for t in edit(f"e{k}", "src/record.py", f"f{k}", f"g{k}")],
        call("w1", "Edit", file_path="src/other.py", old_string="x", new_string="y"), call("w2", "Edit", file_path="src/other.py", old_string="p", new_string="q"), call("w3", "Edit", file_path="src/other.py", old_string="s", new_string="t"),
        back("w1", "ok"), back("w2", "ok"), back("w3", "ok"), ("say", "Renamed."),
        ("user", "Now the guide."), *edit("d1", "docs/guide.md"), *edit("d2", "docs/intro.md"), ("say", "Guide done."),
        ("user", "And these."), *edit("d3", "docs/guide.md"), *edit("d4", "docs/intro.md"), *edit("d5", "docs/more.rst"), ("say", "Done."),
    ],
    "planning": [
        ("user", "Speed up the report."), ("think", NOTES), ("think", "We might cache the report by month."), ("think", NOTES), call("t1", "TodoWrite", todos=["cache"]), back("t1", "ok"),
        call("t2", "TodoWrite", todos=["cache"]), back("t2", "ok"), ("think", "The rounding happens before the sum, so the totals are wrong."),
        *run("c1", "ls src", "report.py"), ("think", "The report is in one module."), ("think", "The report is in one module."), ("think", "The report is in one module."), *edit("e1", "src/report.py"), ("say", "Cached by month."),
    ],
    "handoff": [
        ("user", "Find all callers of the billing client."), call("h1", "Task", description="Search callers", prompt="Search the repository for callers of BillingClient and list the modules"),
        back("h1", "callers: shop/cart.py shop/refund.py"), call("g1", "Grep", pattern="BillingClient", path="repository callers modules"), back("g1", "shop/cart.py"),
        *run("c1", "grep -rn BillingClient . # list repository modules", "shop/cart.py:3"), ("say", "Two callers."),
        ("user", "Thanks. What about invoices?"), call("h2", "Task", description="Invoices", prompt="Count invoices by customer and month"), back("h2", "none"), ("say", "None."),
    ],
    "rewrite": [
        ("user", "Write a loader."), *read("r1", "src/io.py", "\n".join(f"{k}\tline_{k} = {k}" for k in range(10))),
        call("w1", "Write", file_path="src/loader.py", content="\n".join(f"row_{k} = read({k})" for k in range(10))), back("w1", "File created successfully at: src/loader.py"),
        call("w2", "Write", file_path="src/loader.py", content="\n".join(f"row_{k} = read({k})" for k in range(9)) + "\nlast = 1"), back("w2", "The file src/loader.py has been updated."),
        call("w3", "Write", file_path="src/io.py", content="\n".join(f"line_{k} = {k}" for k in range(8)) + "\nmore = 2\nless = 3"), back("w3", "The file src/io.py has been updated."),
        call("w4", "Write", file_path="src/fresh.py", content="one = 1"), back("w4", "File created successfully at: src/fresh.py"), ("say", "Loader written."),
    ],
    "habits": [
        ("user", "Look around the sources."), *run("b1", "cat src/a.py | head -20", "def a(): pass"), *run("b2", "grep -n todo src/a.py", "3: todo"), *run("b3", "find . -name '*.py'", "src/a.py"),
        *run("b4", "ls", "src"), *run("b5", "ls", "src"), *run("b6", "ls  ", "src"), *run("b7", "sed -i s/a/b/ src/a.py", ""), *run("b8", "echo x > src/a.py", ""),
        *run("p1", "apt install jq", "Permission denied"), *run("p2", "apt install jq", "Permission denied"), *run("p3", "apt install jq", "Permission denied"),
        *run("q1", "make", "Error: no rule to make target"), *run("q2", "make", "Error: no rule to make target"), *run("q3", "make", "Error: no rule to make target"), *run("q4", "make", "Error: no rule to make target"),
        call("x1", "Write", file_path="src/tried.py", content="x"), back("x1", "File created successfully at: src/tried.py"), *edit("x2", "src/kept.py"), *edit("x3", "src/kept.py"), *edit("x4", "src/kept.py"),
        *[t for k in range(3) for t in read(f"v{k}", "src/a.py", "def a(): pass")], ("think", "word " * 520), ("say", "Done."),
    ],
    "context": [
        ("user", "Change the greeting."), *[t for k in range(12) for t in read(f"r{k}", f"src/m{k}.py", f"def f{k}(): pass")], *edit("e1", "src/m1.py"), ("say", "Changed m1.py."),
        ("user", "Now the colours, in three places."), *edit("e2", "src/c1.py"), *edit("e3", "src/c2.py"), *edit("e4", "src/c3.py"), *run("c1", "pytest", "4 passed"), ("say", "Coloured."),
    ],
    "odd": [
        ("raw", '{"type":"summary","summary":"Odd shapes","leafUuid":"x"}'), ("raw", '{"type":"queue-operation","operation":"enqueue","sessionId":"odd"}'), ("raw", "   "), ("user", "Start with the odd ones."),
        ("raw", '{"type":"assistant","uuid":"s1","sessionId":"odd","requestId":"q1","timestamp":"2026-01-05T09:00:50Z","message":{"id":"m1","role":"assistant","model":"m-large","content":[{"type":"text","text":"First  part."}],"usage":{"input_tokens":10,"output_tokens":4}}}'),
        ("raw", '{"type":"assistant","uuid":"s2","sessionId":"odd","requestId":"q1","timestamp":"2026-01-05T09:00:51Z","message":{"id":"m1","role":"assistant","model":"m-large","content":[{"type":"text","text":"First part."},{"type":"tool_use","id":"i1","name":"Read","input":{"file_path":"a.py"}}],"usage":{"input_tokens":10,"output_tokens":9}}}'),
        ("raw", '{"type":"assistant","uuid":"s3","sessionId":"odd","requestId":"q2","timestamp":"2026-01-05T09:00:52Z","message":{"role":"assistant","content":[{"type":"tool_use","id":"i2","name":"Bash","input":{"command":"ls"}}]}}'),
        ("raw", '{"type":"user","uuid":"s4","sessionId":"odd","timestamp":"2026-01-05T09:00:53Z","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"i2","content":[{"type":"text","text":"a.py"},{"type":"text","text":"b.py"}]}]}}'),
        ("raw", '{"type":"user","uuid":"s5","sessionId":"odd","timestamp":"2026-01-05T09:00:54Z","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"i1","content":"import os"}]}}'),
        ("raw", '{"type":"user","uuid":"s6","sessionId":"odd","timestamp":"2026-01-05T09:00:55Z","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"i9","content":"who asked?"}]}}'),
        ("raw", '{"type":"user","uuid":"s6","sessionId":"odd","timestamp":"2026-01-05T09:00:55Z","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"i9","content":"who asked?"}]}}'),
        ("raw", '{"type":"user","uuid":"s6","sessionId":"odd","timestamp":"2026-01-05T09:00:56Z","message":{"role":"user","content":"same id, other words"}}'),
        ("raw", '{"type":"assistant","sessionId":"odd","timestamp":"2026-01-05T09:00:57Z","message":{"role":"assistant","content":"No id of its own.","usage":{"input_tokens":true,"output_tokens":"many"}}}'),
        ("raw", '{"type":"mystery","sessionId":"odd","uuid":"s8"}'), call("i3", "Bash", command="sleep 1"), ("say", "Odd, but done."),
    ],
}


def build(session: str, script: list[tuple]) -> list[str]:
    """The lines of a session."""
    out: list[str] = []
    for n, (kind, *rest) in enumerate(script, 1):
        if kind == "raw":
            out.append(rest[0])
            continue
        role = "user" if kind in ("user", "result") else "assistant"
        at = f"2026-01-05T09:{n // 6:02d}:{n % 6 * 10:02d}Z"
        if kind == "user":
            content: object = rest[0]
        elif kind == "result":
            content = [{"type": "tool_result", "tool_use_id": rest[0], "content": rest[1]}]
        elif kind == "call":
            content = [{"type": "tool_use", "id": rest[0], "name": rest[1], "input": rest[2]}]
        else:
            content = [{"type": "thinking", "thinking": rest[0]} if kind == "think" else {"type": "text", "text": rest[0]}]
        # edits that are sent before any result are one request
        record = {"type": role, "uuid": f"{session}-{n}", "sessionId": session, "timestamp": at, "message": {"role": role, "content": content}}
        if role == "assistant":
            record |= {"requestId": f"{session}-q{n}"}
            record["message"] |= {"model": "m-large", "usage": {"input_tokens": 100 + 10 * n, "output_tokens": 20 + n, "cache_read_input_tokens": 50 * n}}  # type: ignore[operator]
        out.append(json.dumps(record, separators=(",", ":")))
    return out


def rows() -> list[tuple[str, int, str]]:
    """file, line (from 1) and value of every line, blank ones too."""
    return [(f"{name}.jsonl", n, line) for name, script in SCRIPTS.items() for n, line in enumerate(build(name, script), 1)]


def raw(spark: SparkSession) -> DataFrame:
    """The lines as flowgauge.sources.transcripts.records takes them."""
    return spark.createDataFrame([r for r in rows() if r[2].strip()], "file string, line int, value string")
