"""License scans: rarest-word lookup in a positional index of licence notices, checked by mandatory phrases."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecorpus.llm._text import alnum_words, apply_texts

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as they stand in files: label, notice, phrases that must be there word for word.
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the terms of the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["fitness for a particular purpose and noninfringement"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ["apache license", "version 2 0"]),
    ("apache-2", "apache software license 2 0", ["apache software license", "2 0"]),
    ("gpl-3", "gnu general public license v3 or later", ["gnu general public license", "v3"]),
    ("gpl-3", "gnu general public license version 3 29 june 2007 copyright free software foundation", ["gnu general public license", "version 3"]),
    ("gpl-2", "gnu general public license v2 or later", ["gnu general public license", "v2"]),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"]),
    ("mpl-2", "mozilla public license version 2 0", ["mozilla public license", "2 0"]),
    ("epl-2", "eclipse public license version 2 0", ["eclipse public license"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("isc", "licensed under the isc license", ["isc license"]),
    ("bsl-1", "boost software license version 1 0", ["boost software license"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international", ["creative commons attribution sharealike"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["free to copy modify publish use"]),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"]),
    # short forms, which must stand as they are
    *[(label, words, [words]) for label, words in [
        ("mit", "mit license copyright"), ("mit", "the mit license mit"), ("mit", "license mit"),
        ("apache-2", "license apache 2 0"), ("apache-2", "apache 2 0 license"), ("apache-2", "apache license 2 0"),
        ("gpl-3", "gplv3"), ("gpl-3", "gpl v3"), ("gpl-3", "gpl version 3"), ("gpl-3", "license gpl 3 0"),
        ("gpl-2", "gplv2"), ("gpl-2", "gpl v2"), ("gpl-2", "gpl version 2"), ("gpl-2", "license gpl 2 0"),
        ("lgpl", "lgplv2"), ("lgpl", "lgplv3"), ("lgpl", "lgpl v2"), ("lgpl", "lgpl v3"), ("agpl-3", "agplv3"), ("agpl-3", "agpl v3"),
        ("mpl-2", "license mpl 2 0"), ("bsd", "under the bsd license"), ("bsd", "bsd 4 clause license"), ("bsd", "license bsd"), ("isc", "license isc"),
        ("cc0", "creative commons zero v1 0 universal"), ("cc0", "under cc0"), ("artistic-2", "artistic license 2 0"), ("unlicense", "under the unlicense"),
    ]],
    # what stands within whole licence texts
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", ["each contributor hereby grants to you a perpetual"]),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works", ["free copyleft license for software and other kinds of works"]),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license", ["by contrast the gnu general public license"]),
    ("lgpl", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", ["gnu lesser general public license incorporates"]),
    ("mpl-2", "each contributor hereby grants you a world wide royalty free non exclusive license under intellectual property rights", ["hereby grants you a world wide royalty free"]),
    ("epl-2", "the accompanying program is provided under the terms of this eclipse public license", ["this eclipse public license"]),
]
#: Labels and the words of their identifiers in SPDX lines.
SPDX = {
    "mit": ["mit"], "apache-2": ["apache 2 0"], "gpl-3": ["gpl 3 0"], "gpl-2": ["gpl 2 0"], "lgpl": ["lgpl 2 0", "lgpl 2 1", "lgpl 3 0"], "agpl-3": ["agpl 3 0"],
    "mpl-2": ["mpl 2 0"], "epl-2": ["epl 2 0"], "bsd": ["bsd 4 clause", "bsd 3 clause", "bsd 2 clause", "0bsd"], "isc": ["isc"], "bsl-1": ["bsl 1 0"], "zlib": ["zlib"], "artistic-2": ["artistic 2 0"],
    "cc-by-nc": ["cc by nc 4 0"], "cc-by-sa": ["cc by sa 4 0"], "cc-by": ["cc by 4 0"], "cc0": ["cc0 1 0"], "unlicense": ["unlicense"],
}
SPDX_HEAD = "spdx license identifier"
#: Words that an SPDX expression may have besides its identifiers.
SPDX_LINKS = ["or", "and", "with", "only", "later", "exception", "classpath", "llvm"]
_SPDX_WORDS = frozenset(w.encode() for words in [*SPDX_LINKS, *(i for ids in SPDX.values() for i in ids)] for w in words.split())
NOTICES.append(("spdx", SPDX_HEAD, [SPDX_HEAD]))

#: Words of a notice that its score is over: its rarest.
INDEX_WORDS = 4
#: Share of these words' weight that must stand at the right relative places.
LEAST_SHARE = 0.75
#: Words that the places of two index words may be off by (added or left-out words).
SLACK = 2


class NoticeIndex:
    """Positional postings word -> (notice, place), all places, of each notice's rarest words by inverse document frequency."""

    def __init__(self, idf: dict[bytes, float], notices=NOTICES):
        self.notices = [(label, n.encode().split(), [p.encode().split() for p in phrases]) for label, n, phrases in notices]
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.total = []
        for t, (_, words, _) in enumerate(self.notices):
            rarest = sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))[:INDEX_WORDS]
            for at, w in enumerate(words):
                if w in rarest:
                    self.postings[w].append((t, at))
            self.total.append(sum(idf.get(w, 1.0) for w in rarest))
        #: The index's words in the order in which a file's are looked up: the rarest first.
        self.rank = {w: k for k, w in enumerate(sorted(self.postings, key=lambda w: (-idf.get(w, 0.0), w)))}

    def find(self, words: list[bytes]) -> dict[str, float]:
        """label -> score (0 to 1) of the notices in a word sequence.

        The file's licence words are looked up from the rarest on. A word opens places for the notices that it is in;
        the words after it only add to places, unless what they and the commoner ones weigh could still do alone.
        """
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.rank:
                places[w].append(i)
        votes: dict[int, dict[int, dict[bytes, float]]] = defaultdict(dict)
        left = dict(enumerate(self.total))
        for w in sorted(places, key=self.rank.__getitem__):
            weight = self.idf.get(w, 1.0)
            for t in {t for t, _ in self.postings[w]}:
                opens, at = left[t] >= LEAST_SHARE * self.total[t], votes[t]
                for q in (q for u, q in self.postings[w] if u == t):
                    for i in places[w]:
                        start = i - q
                        if opens:
                            at.setdefault(start, {})[w] = weight
                        else:
                            for near in range(start - SLACK, start + SLACK + 1):
                                if near in at:
                                    at.setdefault(start, {})[w] = weight
                                    break
                left[t] -= weight
        out: dict[str, float] = {}
        for t, at in votes.items():
            label, notice, phrases = self.notices[t]
            for start in at:
                near: dict[bytes, float] = {}
                for d in range(SLACK + 1):
                    near |= at.get(start + d, {})
                score = sum(near.values()) / self.total[t] if self.total[t] else 0.0
                if score >= LEAST_SHARE and (label == "spdx" or score > out.get(label, 0.0)):
                    window = words[max(0, start - SLACK) : max(0, start + len(notice) + 2 * SLACK)]
                    if not all(_places(window, p) for p in phrases):
                        continue
                    for named in spdx_labels(words, max(0, start - SLACK)) if label == "spdx" else [label]:
                        out[named] = max(out.get(named, 0.0), min(1.0, score))
        return out


def spdx_labels(words: list[bytes], near: int) -> list[str]:
    """Labels of the identifiers in the SPDX expression that follows the first head from ``near`` on: the words up to the first that none has."""
    head = SPDX_HEAD.encode().split()
    start = near + next(iter(_places(words[near : near + 2 * SLACK + 2 * len(head)], head)), 0) + len(head)
    end = start
    while end < len(words) and words[end] in _SPDX_WORDS:
        end += 1
    return [label for label, ids in SPDX.items() if any(_places(words[start:end], i.encode().split()) for i in ids)]


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]


_BASE = [(p.encode().split(), label) for p, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a base phrase stand consecutively."""
    present = set(words)
    return sorted((i, label) for p, label in _BASE if present.issuperset(p) for i in _places(words, p))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """idf of every word of the notices (a fixed, small vocabulary), counted over all documents."""
    vocab = sorted({w.encode() for _, n, _ in NOTICES for w in n.split()})
    known = frozenset(vocab)

    def fn(texts):
        sums = dict.fromkeys(vocab, 0)
        for t in texts:
            for w in known.intersection(alnum_words(t)):
                sums[w] += 1
        rows = [[] for _ in texts]
        if rows:
            rows[0] = [sums[w] for w in vocab]
        return {"df": rows}

    parts = apply_texts(docs.withColumn("one", F.lit(1)).select("one", text_col), text_col, fn, "df array<long>", ["one"])
    rows = parts.select(F.posexplode("out.df").alias("k", "n"), F.lit(1).alias("one")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = docs.count()
    df = {vocab[r.k]: r.n for r in rows}
    return {w: float(np.log((n + 1) / (df.get(w, 0) + 1)) + 0.1) for w in vocab}


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels and score 0. score is the best notice's share of weight in place,
    1 where a base phrase stands. Repeated rows, null and repeated ids included, each get a row; an empty table gives no
    rows; other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(NoticeIndex(document_frequencies(docs, text_col)))

    def fn(texts):
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for t in texts:
            words = alnum_words(t)
            base = base_places(words)
            found = index.value.find(words)
            names = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(base[0][0] if base else None)
            out["last_word"].append(base[-1][0] if base else None)
            out["base_labels"].append(",".join(sorted(names)))
            out["labels"].append(",".join(sorted(names | found.keys())))
            out["score"].append(1.0 if base else max(found.values(), default=0.0))
        return out

    fields = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return apply_texts(docs, text_col, fn, fields, [id_col]).select(F.col(f"row.`{id_col}`").alias(id_col), "out.*")
