import re

import pytest
from pyspark.sql import functions as F

from blockscope.llm import chat_quotes as c
from blockscope.llm import queries


def rows(spark, data):
    kind = "conv_id long, turn long, role string, text string, reply_to string, branch int, conv string, key int"
    return spark.createDataFrame([(*r, "x", 0, "y", 1) for r in data], kind)


def ordered(spark, data):
    return c.reply_ordered(rows(spark, data)).collect()


@pytest.mark.parametrize(
    ("text", "own", "passages"),
    [
        (None, None, None), ("", "", []), ("plain > text", "plain > text", []), ("  keep\n", "  keep\n", []),
        ("> quoted\nmine", "mine", [(1, "quoted")]),
        ("On Monday, Ann wrote:\n> a\n> b\n\nyes\n> c\r\nno", "yes\nno", [(1, "a\nb"), (1, "c")]),
        (">> deep\n> > also deep\n> near\nme", "me", [(1, "near"), (2, "deep\nalso deep")]),
        ("> only a quote", "", [(1, "only a quote")]), (">\n>  \nx", "x", []),
        ("Ann said:\nnot a quote", "Ann said:\nnot a quote", []),
    ],
)
def test_parsing(spark, text, own, passages):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(c.own_text(F.col("t")).alias("own"), c.quoted_passages(F.col("t")).alias("q")).first()
    assert r.own == own
    found = [(p.level, p.passage) for p in r.q or []]
    assert found == (passages or [])


THREAD = [
    (1, 0, "user", "How do I boil an egg?"),
    (1, 1, "assistant", "Put it into water.\nBoil it for six minutes."),
    (1, 2, "user", "And how do I fry one?"),
    (1, 3, "assistant", "> and HOW do  I fry one?\nIn butter."),
    (1, 4, "user", "Ann wrote:\n> Boil it for six minutes.\nThat is long."),
    (1, 5, "assistant", "Then five."),
    (1, 6, "user", "> > Boil it for six minutes.\n> That is long.\n> \nNo it is not."),
    (1, 7, "assistant", "> How do I boil an egg?\nNobody knows."),
    (1, 8, "user", "> never said by anyone\nOdd."),
]


def test_replies_follow_what_they_quote(spark):
    out = ordered(spark, THREAD)
    assert {r.turn: r.reply_to for r in out} == {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 5: 4, 6: 4, 7: 0, 8: 7}
    assert {r.turn: (r.branch, r.depth) for r in out} == {
        0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (4, 1), 5: (4, 1), 6: (6, 2), 7: (7, 1), 8: (7, 1)
    }
    assert [r.turn for r in out] == [0, 1, 2, 3, 4, 5, 7, 8, 6]
    assert [r.turn for r in out if r.quotes] == [3, 4, 7, 6]
    by_turn = {r.turn: r.text for r in out}
    assert by_turn[3] == "In butter." and by_turn[4] == "That is long." and by_turn[8] == THREAD[8][3]
    assert {r.turn: r.unlinked for r in out if r.unlinked} == {8: ["never said by anyone"]}
    place = {r.turn: k for k, r in enumerate(out)}
    assert all(r.reply_to is None or place[r.reply_to] < place[r.turn] for r in out)


def test_no_quoted_text_is_lost(spark):
    long = "On " + "a very long day " * 40 + "Ann wrote:"
    data = [
        (1, 0, "user", "First this. Then that! And more."), (1, 1, "user", f"{long}\n> Then that!\nfine"),
        (1, 2, "user", "> Then that!\n\nwhy\n> unheard of\nmine\n>> deep one"), (1, 3, "user", ">>> print(1)\n> x = 2"),
        (1, 4, "user", "> And\n> more.\nwrapped"),
    ]
    got = {r.turn: (r.reply_to, r.text, r.unlinked) for r in ordered(spark, data)}
    assert got == {
        0: (None, data[0][3], []), 1: (0, "fine", []), 2: (0, "why\nmine", ["unheard of", "deep one"]),
        3: (2, data[3][3], ["x = 2", "print(1)"]), 4: (0, "wrapped", []),
    }


def test_other_conversations_are_not_quoted(spark):
    out = ordered(spark, [(1, 0, "user", "same words"), (2, 0, "user", "other"), (2, 1, "user", "> same words\nhm")])
    assert [r.quotes for r in out] == [False, False, False]


def test_the_latest_of_equal_messages_is_answered(spark):
    data = [(1, k, "user", "yes") for k in range(5)] + [(1, 5, "user", "no"), (1, 6, "user", "> yes\nok"), (1, 7, "user", "yes")]
    assert {r.turn: r.reply_to for r in ordered(spark, data)}[6] == 4


def test_long_conversations_are_looked_up_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(c, "STRETCH", 4)
    data = [(1, 3 * k, "user", f"word {k}" if k % 2 else "the same") for k in range(60)]
    data += [(1, 200 + 3 * k, "user", f"> word {2 * k + 1}\n> the same\nre {k}") for k in range(20)]
    data += [(1, 400, "user", "> re 3\nback")]
    out = ordered(spark, data)
    turns = sorted(r.turn for r in out)
    reply = {r.turn: r.reply_to for r in out}
    for k, t in enumerate(turns):
        if t < 200:
            assert reply[t] == (turns[k - 1] if k else None)
        elif t < 400:
            # the longest match: "word 11 the same" is in no message, "the same" is longer than "word 1"
            n = (t - 200) // 3
            longest = max([("the same", 58 * 3), (f"word {2 * n + 1}", 3 * (2 * n + 1))], key=lambda x: (len(x[0]), x[1]))
            assert reply[t] == longest[1]
    assert reply[400] == 209
    assert {r.depth for r in out if r.turn == 400} == {2}


def test_deep_chains_of_branches(spark):
    data = [(7, 0, "u", "message 0"), (7, 1, "u", "filler")]
    for k in range(1, 40):
        data += [(7, 2 * k, "u", f"> message {k - 1}\nmessage {k}"), (7, 2 * k + 1, "u", f"filler {k}")]
    out = ordered(spark, data)
    assert {r.turn: r.depth for r in out} == {t: t // 2 for t in range(80)}


def test_edge_rows(spark):
    data = [
        (None, 0, "user", "a"), (None, 1, "user", "> a\nb"), (1, None, "user", "a"), (1, 0, None, "x<|im_end|>y"), (1, 0, "user", None),
        (1, 0, "user", None), (1, 3, "user", ""), (1, 4, "user", "> x<|im_end|>y\nz" + " long" * 50_000), (1, -5, "system", "first"),
    ]
    out = ordered(spark, data)
    assert len(out) == len(data)
    assert {(r.conv_id, r.turn): r.reply_to for r in out} == {
        (None, 0): None, (None, 1): None, (1, None): None, (1, 0): -5, (1, 3): 0, (1, 4): 0, (1, -5): None
    }
    odd = next(r for r in out if r.role is None)
    assert odd.chat == "<|im_start|>unknown\nx< |im_end|>y<|im_end|>" and odd.text == "x<|im_end|>y"
    assert c.reply_ordered(rows(spark, [])).count() == 0


def brute(data):
    """Reply, branch and depth for each conversation and turn, message by message."""

    def norm(t):
        return re.sub(r"\s+", " ", t).strip(" ").lower()

    def keys(passage):
        return {norm(x) for x in [passage, *re.split(r"\n[ \t]*\n", passage), *passage.split("\n"), *re.split(r"(?<=[.!?])\s+", passage)]} - {""}

    out, by_conv = {}, {}
    for conv, turn, text in data:
        by_conv.setdefault(conv, {}).setdefault(turn, []).append(text)
    for conv, turns in by_conv.items():
        said, before, branch, depth = {}, None, {}, {}
        for turn in sorted(turns):
            best = None
            for text in turns[turn]:
                lines = [(len(re.sub("[^>]", "", (re.match(c._MARKS, x) or [""])[0])), re.sub(c._MARKS, "", x)) for x in re.split(r"\r?\n", text or "")]
                for level in {n for n, _ in lines} - {0}:
                    run = []
                    for n, body in [*lines, (0, "")]:
                        if n == level:
                            run.append(body)
                            continue
                        for key in keys("\n".join(run)):
                            if key in said:
                                best = max(best or (-level, len(key), said[key]), (-level, len(key), said[key]))
                        run = []
            quoted = best and best[2]
            starts = before is None or (quoted is not None and quoted < before)
            branch[turn] = turn if starts else branch[before]
            if starts:
                depth[turn] = 0 if before is None else depth[branch[quoted]] + 1
            out[conv, turn] = (before if quoted is None else quoted, branch[turn], depth[branch[turn]])
            for text in turns[turn]:
                plain = text or ""
                if re.search(r"(?m)" + c.QUOTED, plain):
                    plain = re.sub(r"(?m)^[ \t]*>[^\n]*(?:\n|\Z)", "", re.sub(c.ATTRIBUTION, "", plain)).strip()
                said |= dict.fromkeys(keys(plain), turn)
            before = turn
    return out


def test_query_equals_brute_force(spark):
    home = "/root/testdata/sf0.01"
    data = [tuple(r) for r in spark.read.parquet(f"{home}/conversations.parquet").select("conv_id", "turn", "text").collect()]
    got = queries.op10_chat_quotes(spark, home).collect()
    assert len(got) == len(data)
    assert {(r.conv_id, r.turn): (r.reply_to, r.branch, r.depth) for r in got} == brute(data)


def test_quotes_laid_over_the_table_equal_brute_force(spark):
    """Every third message also quotes a line of the first, and every fifth one of the second."""
    home = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{home}/conversations.parquet").orderBy("conv_id", "turn").collect()
    first = {}
    for r in table:
        first.setdefault(r.conv_id, []).append(r.text)
    data = []
    for k, r in enumerate(table):
        quoted = first[r.conv_id][0 if k % 3 == 0 else 1 if k % 5 == 0 and len(first[r.conv_id]) > 1 else 0]
        line = quoted.split("\n")[-1]
        quote = f"> {line}\n>> {quoted.split(chr(10))[0]}\n" if r.turn > 1 and (k % 3 == 0 or k % 5 == 0) else ""
        data.append((r.conv_id, r.turn, r.role, quote + r.text))
    out = ordered(spark, data)
    got = {(r.conv_id, r.turn): (r.reply_to, r.branch, r.depth) for r in out}
    assert got == brute([(a, b, t) for a, b, _, t in data])
    assert sum(r.quotes for r in out) > 50


def test_no_python_in_the_plan(spark):
    plan = queries.op10_chat_quotes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
