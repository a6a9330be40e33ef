from pyspark.sql import functions as F

from flowsentry.llm import preferences

SCHEMA = "conv_id long, turn long, role string, text string, p string, side string"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    convs = {c: [(r if hr else "unknown", t) for _, _, hr, r, _, t in sorted(v)] for c, v in convs.items()}
    out = []
    for k in {c // 2 for c in convs}:
        a, b = convs.get(2 * k), convs.get(2 * k + 1)
        n = 0
        while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1

        def show(ts):
            return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)

        def spans(ts):
            at, found = 0, []
            for r, t in ts:
                head = len(f"<|{r}|>\n")
                if r == "assistant":
                    found.append(f"{at + head}:{at + head + len(t) + len('<|end|>')}")
                at += len(show([(r, t)]))
            return ",".join(found)

        def side(x):
            return (show(x[n:]), spans(x[n:])) if x else (None, None)

        out.append((k, 2 * k if a else None, 2 * k + 1 if b else None, n, show(a[:n]) if n else "", *side(a), *side(b)))
    return sorted(out)


def test_equals_brute_force(spark):
    rows = [
        (0, 0, "system", "S"), (0, 1, "user", "hi"), (0, 2, "assistant", "yes 𝒳"), (0, 3, "user", "more"), (0, 4, "assistant", "end"),
        (1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "no"),
        (2, 0, "user", "alone"), (2, 1, "assistant", ""),
        (5, 0, "user", "only rejected"),
        (6, 0, "user", "same"), (6, 1, "assistant", "x"), (7, 0, "user", "same"), (7, 1, "assistant", "x"),
        (8, None, None, None), (8, 0, "assistant", None), (9, None, None, None), (9, 0, "assistant", ""),
        (10, 0, "user", "tie b"), (10, 0, "user", "tie a"), (11, 0, "user", "tie a"), (11, 0, "user", "tie b"), (11, 0, "user", "tie b"),
        (None, 0, "user", "no conversation"),
        (12, 0, "user", "u" * 100_000), (13, 0, "user", "u" * 100_000), (13, 1, "assistant", "z" * 50_000),
        (14, 0, "user", "prefix"), (15, 0, "user", "prefix"), (15, 1, "assistant", "longer"),
    ]
    df = spark.createDataFrame([(*r, "p", "s") for r in rows], SCHEMA).repartition(4)
    conv = F.col("conv_id")
    out = preferences.format_preferences(df, F.floor(conv / 2).cast("long"), F.pmod(conv, F.lit(2)))
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == brute(rows)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    empty = preferences.format_preferences(df.limit(0), F.floor(conv / 2).cast("long"), F.pmod(conv, F.lit(2)))
    assert empty.collect() == []
