"""Names against a plain search over the whole list."""

import random

from pelagos.operators import names


def test_name_matches(spark):
    rng = random.Random(1)
    word = lambda: rng.choice(["lago", "LAGUNA", "rio", "Caburga", "caburgua", "Ñuble", "rupanco", "todos", "los", "santos", "ranc", "abc"])
    known = [" ".join(word() for _ in range(rng.choice([1, 2, 3]))) for _ in range(60)] + ["Caburga", "x", "", None]
    asked = {i: " ".join(word() for _ in range(rng.choice([1, 2, 3, 4]))) for i in range(150)} | {900: "Lago Caburgua", 901: "", 902: "lago", 903: None, 904: "Lago Rancoxx", 905: "abc"}
    up = lambda s: s.upper().replace("Ñ", "N")
    keys = [up(k) for k in known if k is not None]
    want = {}
    for i, name in asked.items():
        if name is None:
            continue
        n = up(name)
        bare = n.split(" ", 1)[1] if " " in n else n
        via = "exact" if n in keys else "bare" if bare in keys else None
        hits = keys.count(n) or keys.count(bare)
        tokens = [t[:6] for t in n.split(" ") if t not in names.NOUNS and len(t) > 3]
        alike = sum(all(t in k for t in tokens) for k in keys) if tokens and not hits else 0
        want[i] = ("SI" if hits == 1 else "DUDOSO" if hits else "NO", via, hits, alike)
    got = names.name_matches(spark.createDataFrame([*asked.items()], "id long, name string"), spark.createDataFrame([(k,) for k in known], "name string"))
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == want
    assert {s for s, *_ in want.values()} == {"SI", "DUDOSO", "NO"} and want[904][3] == 0 and any(x[3] for x in want.values())
