"""Documents for tests."""

import random


def prose(rng, n, words="the of and in that was by for with as river stone light water house garden winter letter paper signal".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", ""]) for _ in range(n))


def make_docs(seed=0, n=60):
    """Documents with copies, near copies, shared passages, boilerplate, odd and null texts."""
    rng = random.Random(seed)
    passage, line = prose(rng, 70), "All readers are asked to return this page today."
    out = []
    for i in range(n):
        kind = i % 10
        text = "\n".join(prose(rng, rng.randint(8, 40)).capitalize() + "." for _ in range(rng.randint(2, 6)))
        if kind == 1 and out:
            text = out[rng.randrange(len(out))][1] or ""
        elif kind == 2:
            text = text + "\n" + passage + "\n" + text[:120]
        elif kind == 3:
            text = line + "\n" + text
        elif kind == 4 and out:
            text = (out[i - 3][1] or "").replace("river", "RIVER", 1) + " end"
        out.append((i, text))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one"), (n + 4, "a" * 1500), (n + 5, "ab " * 4000), (n + 6, "Überß 日本語 — “é” \n" * 30), (n + 7, "x\n" * 300), (n + 8, "#" * 400 + "1")]
    return out
