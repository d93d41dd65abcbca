import hashlib

from sparkstrata.llm.chat import digests, format_examples, parse
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, parts int, example string"
HARD = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "<", "</turn", "#" * 7, "a\\\\b\\", "<\\/turn>", "", "é😀\n\n", "### assistant: : :"]


def rows():
    out = []
    for c in range(6):
        for t in range(c * 2 + 1):
            out.append((c, t, ["user", "assistant", "system", "a:b\\#"][(t + c) % 4 if t else 0], HARD[(c * 3 + t) % len(HARD)], 1, "x"))
    out += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " + "word " * 30, 1, "x") for t in range(120)]
    out += [(60, 0, None, None, 1, None), (60, 0, None, None, 1, None), (60, 1, "assistant", None, 1, None), (None, 0, "user", "lost", 1, None), (None, None, "assistant", "too", 1, None)]
    out += [(70, 0, "assistant", "x " * 40_000, 1, "x")]
    return out


def want(table):
    convs = {}
    for c, t, r, x, *_ in table:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    table = rows()
    examples = format_examples(spark.createDataFrame(table, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(examples).collect()}
    assert got == want(table)


def test_every_reply_is_an_example_with_its_prefix(spark):
    table = [r for r in rows() if r[0] == 50]
    got = format_examples(spark.createDataFrame(table, SCHEMA)).orderBy("example").collect()
    assert [r.example for r in got] == list(range(1, 61)) and [r.closing for r in got] == [False] * 59 + [True]
    for k, r in enumerate(got):
        assert r.text[r.loss_start : r.loss_end] == table[2 * k + 1][3]
        assert r.text[r.loss_end :] == "</turn>\n" and got[-1].text.startswith(r.text)


def test_trailing_turns_close_without_loss(spark):
    got = format_examples(spark.createDataFrame([(1, 0, "user", "a", 1, ""), (1, 1, "assistant", "b", 1, ""), (1, 2, "user", "c", 1, "")], SCHEMA)).orderBy("example").collect()
    assert [(r.loss_start is None, r.closing) for r in got] == [(False, False), (True, True)]


def test_parse_gives_back_hard_texts(spark):
    table = [(1, i, "a:b\\#", x, 1, "") for i, x in enumerate(HARD)]
    closing = format_examples(spark.createDataFrame(table, SCHEMA)).where("closing").select(parse(F.col("text")).alias("t")).first().t
    assert [(x.role, x.text) for x in closing] == [("a:b\\#", x) for x in HARD]


def test_long_roles_and_many_escapes(spark):
    table = [(1, 0, "r" * 1_000_000, "x", 1, ""), (1, 1, "\\:" * 50_000, "#\\" * 100_000, 1, ""), (1, 2, "assistant", "</turn>" * 20_000, 1, "")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_examples(spark.createDataFrame(table, SCHEMA))).collect()}
    assert got == want(table)


def test_empty_table(spark):
    assert digests(format_examples(spark.createDataFrame([], SCHEMA))).collect() == []
