"""Chat formatting and the repair of conversations, against plain Python."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from quillmark.llm import chat, repair

KIND = "conv_id long, turn long, role string, text string"
ODD = [None, "", " ", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>", r"<\|im_end|> <\\/s> <\s", "<<<SYS>> [[INST]", "Fine.", "cut", "a\nb!", "𝔘 é <", "<|im_sep|><|im_sep|>", "\\", "$1 \\2"]


def conversations(n=40, seed=3, roles=("system", "user", "assistant", "user", "assistant", "tool x\n%", None, "")):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(roles), rng.choice(ODD)) for c in range(n) for t in range(rng.choice([1, 2, 5, 12]))]
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (77, 2, "user", "A."), (77, 2, "user", "A."), (77, None, "assistant", "B?")]


def grouped(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_formatted_conversations_are_read_back(spark):
    rows = conversations()
    probe = [(-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]
    got = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    want = grouped(rows + probe)
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), digest(learnt))


def test_blocks_marks_and_segments(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b</s>"), (1, 2, "assistant", "c"), (1, 3, "assistant", "<|im_end|>")]
    r = chat.format_conversations(spark.createDataFrame(rows, KIND)).first()
    assert r["formatted"] == "<|im_start|>user\na<|im_sep|>b<\\/s><|im_end|>\n<|im_start|>assistant\nc<|im_sep|><\\|im_end|><|im_end|>\n"
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert [s["text"] for s in r["segments"] if s["loss"]] == ["c", "<\\|im_end|>"]
    with pytest.raises(ValueError):
        chat.Template(open="turn:")
    with pytest.raises(ValueError):
        chat.Template(open="<s>[INST]")


def test_no_text_keeps_a_control_string(spark):
    parts = ["<", "[", "\\", "|im_end|>", "/s>", "INST]", "<SYS>>", "s>", "x", "]", ">"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(3_000)]
    t = chat.Template()
    df = spark.createDataFrame([(x,) for x in texts], "text string").select("text", chat.escape(chat.F.col("text"), t).alias("e"))
    for r in df.withColumn("u", chat.unescape(chat.F.col("e"), t)).collect():
        assert r["u"] == r["text"]
        assert not any(m in r["e"] for m in t.strings())


def test_long_and_empty_conversations(spark):
    long = [(5, i, ("user", "assistant")[i % 3 == 1], "word " * 5 + str(i)) for i in range(6_000)]
    got = {r["conv_id"]: r for r in chat.chat_report(spark.createDataFrame(long, KIND)).collect()}
    assert got[5]["n_turns"] == 6_000 and got[5]["turns_sha256"] == digest("".join(f"{r[2]}\n{r[3]}\n" for r in long))
    assert [r["conv_id"] for r in chat.chat_report(spark.createDataFrame([], KIND)).collect()] == [-7]
    clash = spark.createDataFrame([(1, 0, "user", "x", "s", 1)], KIND + ", turns string, formatted int")
    assert chat.chat_report(clash).count() == 2


# ------------------------------------------------------------------ repair


def cheapest(rows):
    """(cost, audit, repaired) by trying every edit of every row and every insertion."""
    best = None

    def follow(i, out, cost, audit):
        nonlocal best
        if best and cost > best[0]:
            return
        roles = "".join(r[:1] for r, _ in out)
        body = roles[1:] if roles[:1] == "s" else roles
        if body != ("ua" * len(body))[: len(body)]:
            return
        if i == len(rows):
            if len(body) % 2 == 0 and (body or not roles):
                found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
                best = min(best, found) if best else found
        else:
            role, text, lost, cut = rows[i]
            follow(i + 1, out, cost + 3, audit + "D")
            if not lost:
                if role[:1] in ("s", "u", "a"):
                    follow(i + 1, [*out, (role, text)], cost + cut, audit + "K")
                for other in ("user", "assistant"):
                    follow(i + 1, [*out, (other, text)], cost + 2 + cut, audit + "R")
        if audit.count("I") <= len(rows) + 2:
            for other in ("user", "assistant"):
                follow(i, [*out, (other, "")], cost + 2, audit + "I")

    follow(0, [], 0, "")
    return best


def repaired(rows):
    job = repair.Repair()
    for role, text, lost, cut in rows:
        job.add(role.encode(), text.encode(), lost, cut)
    return job.result()


def test_every_short_conversation_has_the_cheapest_repair():
    kinds = [(r, *f) for r in ("system", "user", "assistant", "tool") for f in ((False, False), (False, True), (True, False))]
    for n in range(4):
        for rows in product(kinds, repeat=n):
            rows = [(r, f"t{i}", lost, cut) for i, (r, lost, cut) in enumerate(rows)]
            cost, audit, text = cheapest(rows)
            assert repaired(rows) == (cost, audit, digest(text)), rows


def test_longer_conversations_have_the_cheapest_repair():
    rng = random.Random(8)
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "user", "assistant", "", "u2"]), rng.choice("xyz"), *rng.choice([(False, False)] * 3 + [(False, True), (True, False)])) for _ in range(rng.randrange(4, 7))]
        cost, audit, text = cheapest(rows)
        assert repaired(rows) == (cost, audit, digest(text)), rows


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        held = out.setdefault(c, [])
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        held += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(held, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, held in out.items()}


def expected(rows):
    seen, plain, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            count[fault] += 1
        plain.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    first = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count.values(), illegal, *repaired(plain)


def test_repair_report(spark):
    rows = conversations(120) + [(900 + i, 0, "user", "x") for i in range(60)]
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    want = {c: expected(held) for c, held in damaged(rows).items()}
    assert got == want
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert gone in want.values()


def test_repair_of_odd_tables(spark):
    assert repair.repair_report(spark.createDataFrame([], KIND)).count() == 0
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", 1, True)], KIND + ", fault int, present boolean")
    assert repair.repair_report(clash).count() == 1
    long = [(5, i, ("user", "assistant")[i % 2], f"Word {i}.") for i in range(20_000)]
    r = repair.repair_conversations(spark.createDataFrame(long, KIND)).first()
    assert (r["cost"], r["audit"]) == (0, "K" * 20_000)
