"""Licence statements by exact set-similarity join of text blocks with templates.

A block is any run of ``block_words`` consecutive words of a text, line ends counting as blanks: BLOCK_WORDS,
or twice the words of the longest template if that is more. A block matches a template when it holds at least
``threshold`` of the template's distinct words. Template words are ordered by how often they occur in all texts, the
rarest first. A block can match only if it holds a word of the template's prefix (the first
|T| - need + 1 words; prefix filter), has at least ``need`` distinct words (length filter), and has
enough words left behind the first common one (positional filter); what passes is counted exactly. The filters look at stretches of twice a block's words, each beginning a block
further, so that any block lies in one; in those that pass, the block slides word by word.

Besides, fixed phrases give base labels wherever their words stand consecutively.

Defined results: null texts are empty; texts without words have no labels and score 0; repeated rows
are labelled one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and licence statements with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
}

BLOCK_WORDS = 64
THRESHOLD = 0.9
#: Bytes that are not part of a word become blanks, A-Z become a-z; all others stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = (text or "").encode() if not isinstance(text, bytes) else text
    return raw.translate(WORD_BYTES).split()


def template_words(templates: dict[str, str]) -> set[bytes]:
    return {w for t in templates for w in words_of(t)}


def word_counts(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """How often each template word occurs in all texts; as many rows come back as templates have words."""
    wanted = template_words(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                found.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.binary()), "n": pa.array(found.values(), pa.int64())})

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counted.collect()}


class Templates:
    """Templates with their words in global order, and the inverted list of their prefixes."""

    def __init__(self, templates: dict[str, str], counts: dict[bytes, int], threshold: float = THRESHOLD):
        words = template_words(templates)
        self.order = {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}
        self.sets, self.set_words, self.prefixes = [], [], {}
        for text, label in sorted(templates.items()):
            ranked = sorted({self.order[w] for w in words_of(text)})
            need = math.ceil(threshold * len(ranked) - 1e-9)
            for at, word in enumerate(ranked[: len(ranked) - need + 1]):
                self.prefixes.setdefault(word, []).append((len(self.sets), at))
            self.sets.append((label, ranked, frozenset(ranked), need))
            self.set_words.append(set(words_of(text)))
        self.block_words = max([BLOCK_WORDS, *(2 * len(words_of(t)) for t in templates)])
        self.least = min((x[3] for x in self.sets), default=0)
        self.rare = [b" " + w + b" " for w, i in self.order.items() if i in self.prefixes]

    def candidate(self, padded: bytes) -> bool:
        """Whether a text, as blank-separated words with blanks around, has a prefix word at all."""
        return any(w in padded for w in self.rare)

    def match(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """Templates that a block contains to the threshold, with the containment."""
        if len(block) < self.least:
            return
        known = sorted(self.order[w] for w in block if w in self.order)
        checked, held = set(), None
        for at, word in enumerate(known):
            for k, place in self.prefixes.get(word, ()):
                if k in checked:
                    continue
                _, ranked, whole, need = self.sets[k]
                checked.add(k)
                # Words of the block that are in no template come after all others and match nothing.
                if len(block) < need or 1 + min(len(ranked) - place - 1, len(known) - at - 1) < need:
                    continue
                held = held if held is not None else set(known)
                common = len(whole & held)
                if common >= need:
                    yield k, common / len(whole)


def most_held(words: list[bytes], wanted: set[bytes], size: int) -> int:
    """The most distinct words of ``wanted`` that stand in ``size`` consecutive words."""
    places = [(i, w) for i, w in enumerate(words) if w in wanted]
    held: Counter = Counter()
    most = first = 0
    for i, w in places:
        held[w] += 1
        while i - places[first][0] >= size:
            out = places[first][1]
            held[out] -= 1
            if not held[out]:
                del held[out]
            first += 1
        most = max(most, len(held))
    return most


def find(words: list[bytes], index: Templates) -> Iterator[tuple[int, float]]:
    """Templates that a block of a text contains to the threshold, with the containment."""
    size = index.block_words
    for at in range(0, max(len(words) - size, 1), size):
        stretch = words[at : at + 2 * size]
        for k, containment in index.match(set(stretch)):
            _, _, whole, need = index.sets[k]
            if len(stretch) > size:
                common = most_held(stretch, index.set_words[k], size)
                if common < need:
                    continue
                containment = common / len(whole)
            yield k, containment


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: word and phrase counts, base labels, all labels, best containment."""
    index = Templates(templates, word_counts(docs, templates), threshold)
    padded_phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                padded = b" " + b" ".join(words) + b" "
                places, base, labels, score = [], set(), set(), 0.0
                for phrase, label in padded_phrases:
                    at, counted, place = padded.find(phrase), 0, 0
                    while at >= 0:
                        place += padded.count(b" ", counted, at)
                        counted = at
                        places.append(place)
                        base.add(label)
                        at = padded.find(phrase, at + 1)
                if index.candidate(padded):
                    for k, containment in find(words, index):
                        labels.add(index.sets[k][0])
                        score = max(score, containment)
                score = 1.0 if base else score
                out.append(
                    (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)
                )
            cols = list(zip(*out, strict=True)) or [()] * 7
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
