"""Chat formatting against brute force, an exact round trip, and templates that rewrite history."""

from __future__ import annotations

import hashlib
import random

from cropstats.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, part int"
BITS = [*chat.CONTROL, "\\", "\\n", "\n", "<", "|>", "a", "é", "😀", " ", "<|im_", "[", "n", ""]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(4)


def brute(rows: list[tuple]) -> dict:
    out: dict = {}
    none_first = lambda v: (v is not None, v if v is not None else 0)
    text_order = lambda v: (v is not None, (v or "").encode())
    for r in sorted(rows, key=lambda r: (none_first(r[1]), text_order(r[2]), text_order(r[3]))):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    escape = chat.escaper(chat.CONTROL)
    made = {}
    for conv, turns in out.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = chat.MARKED.render([(escape(role), escape(t)) for role, t in turns])
        made[conv] = (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss), len(whole))
    return made


def got(spark, rows) -> dict:
    return {r[0]: tuple(r)[1:] for r in chat.digests(chat.written(chat.formatted(frame(spark, rows)))).collect()}


def test_digests_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 3000)
    rng = random.Random(2)
    text = lambda n: rng.choice([None, "", "".join(rng.choice(BITS) for _ in range(n))])
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(-3, 9)]), rng.choice(["user", "assistant", "system", None, "", "<s>\nn\\"]), text(rng.randint(0, 30))) for _ in range(400)]
    rows += [(99, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1500)]  # a hot conversation: many segments and parts
    rows += [(98, 5, "assistant", f"same turn {i % 7}") for i in range(300)]  # ties and repeated rows
    rows += [(97, 0, "user", "x" * 300_000), (97, 1, "assistant", "<s>\\" * 100_000)]
    assert got(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert got(spark, []) == {}


def test_escapes_round_trip_and_break_every_mark():
    escape, rng = chat.escaper(chat.CONTROL), random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        assert chat.unescaped(escape(text)) == text and not any(c in escape(text) for c in chat.CONTROL)
        assert chat.unlined(chat.line(escape(text))) == text and "\n" not in chat.line(escape(text))
        turns = [("user", text), (text, "b"), ("assistant", text)]
        assert list(chat.parsed(chat.MARKED.render([(escape(r), escape(t)) for r, t in turns]))) == turns


def test_spans_of_turns_and_texts():
    rng = random.Random(3)
    for template in (chat.MARKED, chat.INSTRUCTIONS):
        for _ in range(200):
            turns = [("system", "".join(rng.choice("ab<[ ") for _ in range(4)))] * rng.randint(0, 1)
            turns += [("assistant" if i % 2 else "user", "".join(rng.choice("ab<[ \n") for _ in range(rng.randint(0, 6)))) for i in range(rng.randint(1, 7))]
            made = chat.located(template.render, turns)
            assert made.rewritten is None and made.text == template.render(turns)
            assert [a for a, _ in made.spans] == [0, *(b for _, b in made.spans)][:-1] and made.spans[-1][1] == len(made.text)
            for (role, text), body, span in zip(turns, made.bodies, made.spans, strict=True):
                if template is chat.MARKED or role != "system":
                    assert made.text[body[0]:body[1]] == text and span[0] <= body[0] and body[1] <= span[1]
                    assert made.text[body[1]:].startswith(("<|im_end|>", " [/INST]", " </s>"))
                else:
                    assert body is None  # rendered with the next turn only


def test_templates_that_rewrite_history():
    turns = [("system", "be brief"), ("user", "one"), ("assistant", "1"), ("user", "two"), ("assistant", "2")]
    made = chat.located(chat.SYSTEM_LAST.render, turns)
    assert made.rewritten == 3 and made.spans == [None] * 5
    assert [made.text[a:b] for a, b in made.bodies] == [t for _, t in turns]
    assert chat.located(chat.SYSTEM_LAST.render, turns[:3]).rewritten is None
    dropping = lambda turns: "".join(f"[{r}]{t if i >= len(turns) - 2 else ''}" for i, (r, t) in enumerate(turns))
    made = chat.located(dropping, turns)
    assert made.rewritten == 2 and made.bodies[:3] == [None] * 3 and made.text[slice(*made.bodies[4])] == "2"
    changed = chat.located(lambda turns: "".join(t.strip() + ";" for _, t in turns), [("user", " a "), ("user", "b")])
    assert changed.bodies == [None, (2, 3)]  # a text that the template changes is not located


def test_other_templates_over_a_table(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 300, "user", "v"), (1, 301, "assistant", "b"), (2, 0, "user", "only")]
    made = {(r.conv_id, r.segment): r for r in chat.formatted(frame(spark, rows), chat.SYSTEM_LAST).collect()}
    assert set(made) == {(1, 0), (2, 0)} and made[1, 0].rewritten == 3 and made[2, 0].rewritten is None
    assert [made[1, 0].formatted[s.start:s.end] for s in made[1, 0].loss] == ["a", "b"] and made[2, 0].loss == []
    plain = chat.formatted(frame(spark, rows), chat.INSTRUCTIONS, trained=("user",)).where("conv_id = 1").first()
    assert plain.formatted == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\nu [/INST] a </s><s>[INST] v [/INST] b </s>" and len(plain.turns) == 5 and len(plain.loss) == 2
