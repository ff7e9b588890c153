"""Plain pairwise definitions that the Spark joins are compared with, on small input only."""

from difflib import SequenceMatcher

from urlrisk import constants as C

FOLD = {ch: letter for letter, chars in C.CONFUSABLES.items() for ch in chars}


def skeleton(text):
    folded = "".join(FOLD.get(ch, ch.lower()) for ch in text)
    for pair, letter in C.CONFUSABLE_PAIRS:
        folded = folded.replace(pair, letter)
    return folded


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def root(domain):
    parts = domain.split(".")
    take = 3 if ".".join(parts[-2:]) in C.TWO_LEVEL_SUFFIXES else 2
    return ".".join(parts[-take:])
