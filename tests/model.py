"""Plain models of the scores, written from their definitions and used as the other side of tests."""

import math
import re
import string
from collections import Counter

PUNCTUATION = set("!\"#$%&()*+/:;<=>?@[\\]^_`{|}~ ")


def normalise(s):
    s = "".join(c for c in s.lower().replace("<pad>", "").replace("</s>", "") if c not in string.punctuation)
    return " ".join(" ".join("" if w in ("a", "an", "the") else w for w in re.split(r"(\W)", s)).split())


def scored(s, preserve_case=False):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = s.replace(a, b)
    s = f" {s} "
    s = s if preserve_case else s.lower()
    out = "".join(f" {c} " if c in PUNCTUATION else c for c in s)
    out = re.sub(r"([^0-9])([.,])", lambda m: f"{m[1]} {m[2]} ", out)
    out = re.sub(r"([.,])([^0-9])", lambda m: f" {m[1]} {m[2]}", out)
    return re.sub(r"([0-9])-", lambda m: f"{m[1]} - ", out).split()


def grams(tokens, k):
    return Counter(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))


def totals(pairs, cut, length, n=4):
    """pairs: (hypothesis, references)."""
    hyp = ref = 0
    guess, correct = [0] * n, [0] * n
    for h, rs in pairs:
        h, rs = cut(h), [cut(r) for r in rs]
        sizes = [len(r) for r in rs]
        hyp += len(h)
        ref += int({"shortest": min(sizes), "average": sum(sizes) / len(sizes), "closest": min(sizes, key=lambda x: abs(x - len(h)))}[length])
        for k in range(1, n + 1):
            guess[k - 1] += max(len(h) - k + 1, 0)
            best = Counter()
            for r in rs:
                best |= grams(r, k)
            correct[k - 1] += sum((grams(h, k) & best).values())
    return hyp, ref, guess, correct


def smooth(pairs, cut=scored, length="shortest", n=4):
    hyp, ref, guess, correct = totals(pairs, cut, length, n)
    logs = sum(math.log(c + (k > 0) + 1e-16) - math.log(g + (k > 0) + 1e-16) for k, (c, g) in enumerate(zip(correct, guess)))
    return math.exp(logs / n + min(0.0, 1 - (ref + 1) / (hyp + 1)))


def plain(pairs, add, n=4):
    hyp, ref, guess, correct = totals(pairs, str.split, "shortest", n)
    ps = [(c + 1) / (g + 1) if add else (c / g if g else 0.0) for c, g in zip(correct, guess)]
    if min(ps) <= 0:
        return 0.0
    ratio = hyp / max(1, ref)
    return math.exp(sum(map(math.log, ps)) / n) * (1.0 if ratio > 1 else math.exp(1 - 1 / max(ratio, 1e-9)))
