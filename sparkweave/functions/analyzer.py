"""Text analysis for keyword search: split at what is no letter or digit, lower-case, drop stopwords, stem.

Splitting, case and stopwords are Spark functions. English, French, German and Spanish stems need Python (an Arrow UDF over
the words of a text; a task stems a word once); the analyzer "none" leaves words as they are and stays in the JVM. Languages whose
stemmer is not written here raise an error rather than being indexed unstemmed. Chinese has no dictionary here and is
cut into two-character pieces, a deviation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stemmer import stem_english
from .stemmer_french import stem_french
from .stemmer_german import stem_german
from .stemmer_spanish import stem_spanish

#: The English stopwords.
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with you your
yours yourself yourselves
""".split()

#: Languages and their tags.
LANGUAGES = {
    "english": "en",
    "arabic": "ar",
    "danish": "da",
    "dutch": "nl",
    "finnish": "fi",
    "french": "fr",
    "german": "de",
    "greek": "el",
    "hungarian": "hu",
    "italian": "it",
    "norwegian": "no",
    "portuguese": "pt",
    "romanian": "ro",
    "russian": "ru",
    "spanish": "es",
    "swedish": "sv",
    "tamil": "ta",
    "turkish": "tr",
    "chinese": "zh",
}
NOT_A_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def language(name: str) -> str:
    """The full name of a language given by name or tag; "none" for no stemming."""
    name = name.strip().lower()
    if name == "none" or name in LANGUAGES:
        return name
    for full, tag in LANGUAGES.items():
        if tag == name:
            return full
    raise ValueError(f"unknown language {name!r}")


#: Words whose stems a task remembers, and those of one batch.
KNOWN_WORDS = 500_000

#: Languages with a stemmer here.
STEMMERS = {"english": stem_english, "french": stem_french, "german": stem_german, "spanish": stem_spanish}


def _stems(words: Column, lang: str) -> Column:
    stem = STEMMERS[lang]

    known: dict[str, str] = {}

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(words: pa.Array) -> pa.Array:
        # tokens stay in Arrow; only words that the task has not met go through Python
        found = words.flatten().dictionary_encode()
        if len(known) > KNOWN_WORDS:
            known.clear()
        own = found.dictionary.to_pylist()
        for w in own:
            if w not in known:
                known[w] = stem(w)
        stems = pa.array([known[w] or None for w in own], pa.string()).take(found.indices)
        row = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        kept = stems.is_valid()
        ends = np.cumsum(np.bincount(row[kept.to_numpy(zero_copy_only=False)], minlength=len(words)))
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        return pa.ListArray.from_arrays(offsets, stems.filter(kept), mask=words.is_null())

    return run(words)


def words(text: Column) -> Column:
    """Lower-case words of a text, in order."""
    return F.transform(F.filter(F.split(text, NOT_A_WORD), lambda w: w != ""), F.lower)


def terms(text: Column, lang: str = "english") -> Column:
    """Index terms of a text, in order."""
    lang = language(lang)
    if lang == "none":
        return words(text)
    if lang in STEMMERS:
        kept = F.filter(words(text), lambda w: ~w.isin(STOPWORDS)) if lang == "english" else words(text)
        return _stems(kept, lang)
    if lang == "chinese":
        pieces = F.transform(words(text), lambda w: F.when((F.length(w) < 3) | ~w.rlike(r"\p{IsHan}"), F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))))
        return F.flatten(pieces)
    raise ValueError(f"no stemmer for {lang}")


def query_terms(text: str, lang: str = "english") -> list[str]:
    """Distinct terms of a query text, with the same rules, for a query that is part of a plan."""
    import re
    import unicodedata

    lang = language(lang)
    keep = lambda c: c.isalpha() or c.isalnum() or unicodedata.category(c)[0] == "N" or unicodedata.category(c) in ("Mn", "Mc") and c.isalpha()
    found = ["".join(g) for g in re.split(r"\x00+", "".join(c if keep(c) else "\x00" for c in text)) if g]
    found = [w.lower() for w in found]
    if lang in STEMMERS:
        found = [STEMMERS[lang](w) for w in found if lang != "english" or w not in STOPWORDS]
    elif lang == "chinese":
        found = [p for w in found for p in ([w] if len(w) < 3 or not re.search("[一-鿿]", w) else [w[i : i + 2] for i in range(len(w) - 1)])]
    elif lang != "none":
        raise ValueError(f"no stemmer for {lang}")
    return list(dict.fromkeys(w for w in found if w))
