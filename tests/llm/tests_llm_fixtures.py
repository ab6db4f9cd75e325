"""Texts and brute-force versions that several tests use."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if c == y else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}
