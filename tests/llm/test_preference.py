"""Preference formatting against plain loops."""

from tagweave.llm import preference

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "bye"),
    (2, 1, "assistant", "hello"), (2, 0, "user", "hi"), (3, 0, "user", "no answer"),
    (5, 0, "user", "a"), (5, 1, "assistant", "b"), (5, 2, "user", "c"), (5, 3, "assistant", "dé 🙂"),
    (6, 0, None, None), (6, 1, "assistant", None), (6, None, "assistant", "first"), (6, 1, "assistant", "tie"),
    (7, 0, "assistant", "x" * 100_000), (7, 0, "assistant", "x" * 100_000), (8, 0, "assistant", "x" * 100_000),
    (None, 0, "user", "lost"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    return [(role or "", text or "") for _, role, text in ordered]


def render(turns):
    text, spans = "", []
    for role, body in turns:
        start = len(text) + len(f"<|im_start|>{role}\n")
        text += f"<|im_start|>{role}\n{body}<|im_end|>\n"
        if role == "assistant":
            spans.append(f"{start}:{start + len(body) + len('<|im_end|>')}")
    return text, ",".join(spans)


def pair(key, a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return (key, n, render(a[:n])[0], *render(a[n:]), *render(b[n:]))


def slow_pairs(rows):
    chosen = {}
    for key in {r[0] for r in rows} - {None}:
        turns = turns_of([r[1:] for r in rows if r[0] == key])
        places = [i for i, (role, _) in enumerate(turns) if role == "assistant"]
        if places:
            chosen[key] = turns[:places[-1] + 1]
    order = sorted(chosen)
    following = dict(zip(order, order[1:]))
    for key, turns in chosen.items():
        donor = chosen.get(following.get(key))
        yield pair(key, turns, turns[:-1] + [("assistant", donor[-1][1] if donor else "")])


def test_swapped_replies(spark, sf):
    rows = ROWS + [(r["conv_id"] + 1000, r["turn"], r["role"], r["text"])
                   for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'extra' AS turns", "'extra' AS chosen", "2 AS a")
    got = preference.formatted(frame).collect()
    assert sorted(map(tuple, got)) == sorted(slow_pairs(rows))
    spans = {r["conv_id"]: (r["chosen"], r["chosen_mask"]) for r in got}
    text, mask = spans[5]
    start, end = map(int, mask.split(":"))
    assert text[start:end] == "dé 🙂<|im_end|>"


def test_pairs_of_any_conversations(spark):
    """Prefixes of different lengths, one inside the other, equal, and without a partner."""
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "x"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "user", "r"), (4, 0, "user", "p")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "y"), (1, 2, "user", "z"), (2, 0, "user", "q"), (2, 1, "assistant", "s"),
         (3, 0, "user", "q"), (3, 1, "user", "r"), (9, 0, "user", "p")]
    one, two = (preference.gathered(spark.createDataFrame(x, SCHEMA), "conv_id") for x in (a, b))
    got = preference.preference_pairs(one, two, "conv_id").collect()
    want = [pair(k, turns_of([r[1:] for r in a if r[0] == k]), turns_of([r[1:] for r in b if r[0] == k])) for k in (1, 2, 3)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_keys_with_gaps_and_keys_of_text(spark):
    """Only the last conversation with a reply finds no other reply."""
    rows = [(key, turn, role, f"{key} {role}") for key in ("b", "aa", "z", "ä", "a") for turn, role in enumerate(("user", "assistant"))]
    rows += [("c", 0, "user", "no reply"), ("y", 0, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string")).repartition(7)
    got = preference.formatted(frame).collect()
    assert sorted(map(tuple, got)) == sorted(slow_pairs(rows))
    assert sum("\n<|im_end|>" in r["rejected"] for r in got) == 1


def test_no_conversations(spark):
    assert preference.formatted(spark.createDataFrame([], SCHEMA)).collect() == []
