"""Chat formatting: exact round trip and a plain counterpart."""

import hashlib
import random

from ledgerspan.llm import chat


def plain(turns):
    esc = lambda s: "".join("\\" + c if c in "\\<[]" else c for c in s)
    return "".join(f"<s>[{esc(r)}] {esc(t)}</s>" for r, t in turns)


def test_round_trip(spark):
    rng = random.Random(3)
    pool = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\<s>[a] b</s>", "é中😀<", "x" * 30_000, "<s>[assistant] hi</s>\n", "] "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a]b", "assistant"]), rng.choice(pool), "clash") for c in [*range(60), None] for t in range(rng.randint(1, 6))]
    rows += [(7, 2, "user", "tie", "c"), (7, 2, "user", "tie", "c"), (8, None, "user", "no turn", "c")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: r for r in chat.format_chats(df).collect()}
        digests = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for c, t, r, x, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        g, d = got[c], digests[c]
        assert g.formatted == plain(turns) and g.n_turns == len(turns) == d.n_turns
        assert chat.parse(g.formatted) == turns
        loss = "".join(x for r, x in turns if r == "assistant")
        assert chat.loss_text(g.formatted, g.loss_start, g.loss_end) == loss
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(g.formatted))


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(df)).collect() == []
