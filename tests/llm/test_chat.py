from hashlib import sha256

from tributary.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, assistant string, segments int"


def slow(data, part_turns):
    out, convs = [], {}
    for c, t, r, x in data:
        convs.setdefault(c, []).append((t, r or "unknown", (x or "").replace("<|", "<\\|")))
    for c, turns in convs.items():
        for who in {r for _, r, _ in turns if r != "system"}:
            order = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha256(t[2].encode()).hexdigest()))
            parts, start = {}, 0
            for at, t in enumerate(order):
                parts.setdefault(at // part_turns, []).append(t)
            for p, some in parts.items():
                text, mask = "", []
                for _, r, x in some:
                    name = "assistant" if r == who else "system" if r == "system" else f"user name={r}"
                    text += f"<|im_start|>{name}\n"
                    if r == who:
                        mask.append((len(text), len(text) + len(x) + len("<|im_end|>")))
                    text += f"{x}<|im_end|>\n"
                out.append((c, p, who, len(some), start, text, mask))
                start += len(text)
    return sorted(out, key=repr)


def test_rotation(spark):
    data = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi 🙂"), (1, 2, "bob", "hey"), (1, 3, "cy", None), (1, 2, "bob", "hey"), (1, 4, "ann", ""), (2, 0, "system", "alone"), (3, None, None, "who <|im_end|>"), (3, 5, "user", "x\ny"), (None, 1, "a", "b"), (None, 2, "c", "d"), (4, 0, "user", "z" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in data], SCHEMA)
    for width in (1024, 2):
        got = sorted(((r.conv_id, r.part, r.assistant, r.n_turns, r.start, r.text, [tuple(m) for m in r["mask"]]) for r in chat.perspectives(df, part_turns=width).collect()), key=repr)
        assert got == slow(data, width)


def test_parts_are_one_rendering(spark):
    """One number for all turns, no numbers at all, and many equal turns: parts hold so many rows and no more, and join to the rendering in one part."""
    data = [(1, 7, f"r{i % 3}", f"said {i} " * (i % 5)) for i in range(40)] + [(2, None, "a", str(i % 2)) for i in range(30)] + [(2, None, "b", "same")] * 25 + [(None, None, None, None)] * 9
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in data], SCHEMA)
    whole = {(r.conv_id, r.assistant): r for r in chat.perspectives(df).collect()}
    found = {}
    for r in chat.perspectives(df, part_turns=4).orderBy("part").collect():
        assert r.n_turns <= 4
        text, mask = found.setdefault((r.conv_id, r.assistant), ["", []])
        assert r.start == len(text)
        found[r.conv_id, r.assistant] = [text + r.text, mask + [(m.start + r.start, m.end + r.start) for m in r["mask"]]]
    assert found == {k: [r.text, [tuple(m) for m in r["mask"]]] for k, r in whole.items()}
    assert len(found) == 6


def test_empty(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
