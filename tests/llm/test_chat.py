import hashlib
import random

import duckdb
from penprint.llm import chat
from penprint.llm.queries import CONTROL_TURNS, OP12_SQL
from pyspark.sql import functions as F

LOG = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"
ODD = ["<|end|>", "<|", "</s>", "[INST]", "\\", "\\\\<|text|>", "<", "|end|>", "\n", "a\\n", "漢🙂", "<\\|end|>", "", "<<SYS>>",
       "</SYS>", "$1", "é"]


def odd_text(rnd):
    return "".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 12)))


def fold(events):
    """The log replayed event by event."""
    shown = {}
    for _, _, message, kind, role, text in sorted(set(events), key=lambda e: e[1]):
        if kind == "open":
            shown[message] = (role or "", shown.get(message, ("", ""))[1], True)
        elif kind == "regenerate":
            for m in [m for m in shown if m > message]:
                del shown[m]
            if message in shown:
                shown[message] = (shown[message][0], "", shown[message][2])
        elif kind in ("delta", "edit"):
            old = shown.get(message, ("", "", False))
            shown[message] = (old[0], (text or "") if kind == "edit" else old[1] + (text or ""), old[2])
    return {m: (r, t) for m, (r, t, opened) in shown.items() if opened}


def test_logs_fold_as_if_replayed(spark):
    rnd = random.Random(8)
    log = []
    for conv in range(150):
        for seq in range(rnd.randint(1, 40)):
            kind = rnd.choice(["open", "open", "delta", "delta", "delta", "delta", "edit", "regenerate", "typing"])
            log.append((conv, seq, rnd.randint(0, 4), kind, rnd.choice(["user", "assistant", None]), rnd.choice(["ab", "c", None, "漢"])))
    log += rnd.sample(log, 200)
    rows = spark.createDataFrame(log, LOG).withColumn("piece", F.lit("x")).repartition(4)
    want = sorted((c, m, r, t) for c in range(150) for m, (r, t) in fold([e for e in log if e[0] == c]).items())
    assert sorted(map(tuple, chat.reconstruct(rows).collect())) == want


def test_texts_come_back_whatever_they_hold(spark):
    rnd = random.Random(9)
    turns = [(c, m, rnd.choice(["user", "assistant", "system", odd_text(rnd)]), odd_text(rnd)) for c in range(60) for m in range(6)]
    messages = spark.createDataFrame(turns, "conv_id bigint, message bigint, role string, text string")
    formatted = chat.render(messages)
    got = {(r.conv_id, r.position): (r.role, r.text, r.loss_text) for r in chat.read_back(formatted).collect()}
    assert got == {(c, m): (r, t, t if r == "assistant" else "") for c, m, r, t in turns}
    for row in formatted.collect():
        plain = row.formatted
        for mark in (chat.START, chat.TEXT, chat.END):
            assert plain.count(mark) == 6
            plain = plain.replace(mark, "\0")
        assert not any(c in plain for c in chat.CONTROL)
        spans = [plain_part for s, n in row.loss for plain_part in [row.formatted[s:s + n]]]
        assert [s for s in spans if s] == [chat_text for chat_text in spans if chat_text]
        assert all(row.formatted[s + n:].startswith(chat.END) and row.formatted[:s].endswith(chat.TEXT)
                   for s, n in row.loss if n)


def turns_table(spark, data):
    return spark.createDataFrame([(*row, f"x{k}", k) for k, row in enumerate(data)],
                                 "conv_id bigint, turn bigint, role string, text string, message string, seq int")


def plain(data):
    out = {}
    for c, t, r, x in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or 0, d[2] or "", d[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = []
    for c, turns in out.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        rows.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return sorted(rows, key=repr)


def test_query_columns_of_odd_tables(spark):
    rnd = random.Random(10)
    data = [(c, t, rnd.choice(["user", "assistant", "system", None]), rnd.choice([odd_text(rnd), None, "long " * rnd.randint(0, 900)]))
            for c in range(80) for t in range(rnd.randint(1, 7))]
    data += [(3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "user", "no id"), (None, None, "assistant", "nothing"),
             (500, None, "assistant", "a" * 300_000), (501, 0, "assistant", ""), *CONTROL_TURNS]
    got = chat.formatted_conversations(turns_table(spark, data).repartition(5))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == plain(data)
    assert chat.formatted_conversations(turns_table(spark, [])).collect() == []


def test_sql_gives_the_same_rows(spark, tmp_path):
    rnd = random.Random(11)
    data = [(c, t, rnd.choice(["user", "assistant"]), odd_text(rnd)) for c in range(40) for t in range(4)] + [(90, 0, None, None)]
    from penprint.llm.queries import op12_chat_format
    turns_table(spark, data).write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_chat_format(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(OP12_SQL)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_no_python_and_one_exchange(spark):
    rows = turns_table(spark, [(1, 0, "user", "hi")])
    plan = chat.formatted_conversations(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
