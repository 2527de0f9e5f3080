"""Quotation linking against a matcher by hand, through the registered query."""

import re

import numpy as np

from sluicegate.llm import queries


def passages(text):
    text = text or ""
    lines = re.split(r"\r\n|\r|\n", text)
    parsed = []
    for x in lines:
        m = re.match(r"[ \t]*((>[ \t]?)+)", x)
        parsed.append((m.group(1).count(">") if m else 0, x[m.end() :] if m else x))
    runs = []
    for level, body in parsed:
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    return [(level, "\n".join(b)) for level, b in runs if "".join(b).strip()]


def plain(text):
    return re.sub(r"\s+", " ", text.lower()).strip(" ")


def units(body):
    return {plain(x) for x in (body, *re.split(r"\n\s*\n", body), *body.split("\n"))} - {""}


def by_hand(rows):
    own = {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for level, body in passages(text):
                if level == 0:
                    for u in units(body):
                        own.setdefault((conv, u), set()).add(turn)
    out = []
    for conv, turn, role, text in rows:
        quoted = [(level, body) for level, body in passages(text) if level > 0]
        linked, answers = 0, []
        if conv is not None and turn is not None:
            for _, body in quoted:
                hits = [(len(u), max(t for t in own.get((conv, u), ()) if t < turn)) for u in units(body) if any(t < turn for t in own.get((conv, u), ()))]
                if hits:
                    linked += 1
                    answers.append((-min(x for x, other in quoted if plain(other) == plain(body)), max(hits)[1]))
        before = [t for c, t, _, _ in rows if c == conv and t is not None and turn is not None and t < turn] if conv is not None else []
        reply = max(answers)[1] if answers else max(before, default=None)
        out.append((conv, turn, role, reply, linked, len(quoted)))
    return sorted(out, key=repr)


def made(rng, n):
    """Conversations whose messages quote others, and quotes in those, nested."""
    said = ["Hello there", "I think so", "the plan\n\nhas two paragraphs", "one line\nother line", "no  Odd   spacing", "ok", "ÄÖÜ straße"]
    rows, texts = [], {}
    for _ in range(n):
        conv, turn = int(rng.integers(4)), int(rng.integers(12))
        parts = []
        for _ in range(int(rng.integers(0, 3))):
            old = texts.get((conv, int(rng.integers(12))), str(rng.choice([*said, "never said"])))
            if rng.random() < 0.3:
                old = str(rng.choice(old.split("\n")))
            mark = str(rng.choice(["> ", ">", ">> ", " > > "]))
            parts.append("\n".join(mark + x for x in old.split("\n")))
        parts.insert(int(rng.integers(len(parts) + 1)), str(rng.choice(said)).upper() if rng.random() < 0.3 else str(rng.choice(said)))
        text = str(rng.choice(["\n", "\n\n", "\r\n"])).join(parts)
        texts[conv, turn] = text
        rows.append((conv, turn, "user", text))
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = made(np.random.default_rng(8), 220)
    # rows that share a turn, equal and not; nulls
    rows += [(9, 0, "user", "a statement"), (9, 1, "user", "> a statement\nyes"), (9, 1, "user", "> unknown words\nno"), (9, 1, "user", "> a statement\n> a statement\n\n> a statement\nyes"), *rows[:6], rows[0]]
    rows += [(None, 1, "user", "> a statement"), (9, None, "user", "> a statement"), (9, 2, None, None), (10, 5, "x", ""), (10, 6, "x", "> " * 300 + "deep")]
    spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, level int, passage string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op8_quotation_linking(spark, str(tmp_path)).collect()
    want = by_hand(rows)
    assert sorted(((r.conv_id, r.turn, r.role, r.reply_to, r.linked_quotes, r.n_quotes) for r in got), key=repr) == want
    assert sum(w[4] for w in want) > 100
