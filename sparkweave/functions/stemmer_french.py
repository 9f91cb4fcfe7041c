"""French stems, after the published Snowball rules. Capitals mark vowels that stand for consonants."""

from __future__ import annotations

from .regions import longest, standard_regions

VOWELS = frozenset("aeiouyâàëéêèïîôûù")

# The suffixes of each step.
DELETED = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
ACTIONS = "atrice ateur ation atrices ateurs ations".split()
CHANGED = {"logie": "log", "logies": "log", "usion": "u", "ution": "u", "usions": "u", "utions": "u", "ence": "ent", "ences": "ent"}
ADVERBS = {"amment": "ant", "emment": "ent"}
STEP_1 = [*DELETED, *ACTIONS, *CHANGED, *ADVERBS, *"ement ements ité ités if ive ifs ives eaux aux euse euses issement issements ment ments".split()]
I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _marked(word: str) -> str:
    out = list(word)
    vowel = lambda i: 0 <= i < len(out) and out[i] in VOWELS
    for i, c in enumerate(out):
        if c in "ui" and vowel(i - 1) and vowel(i + 1) or c == "y" and (vowel(i - 1) or vowel(i + 1)) or c == "u" and i and out[i - 1] == "q":
            out[i] = c.upper()
    return "".join(out)


def _rv(word: str) -> int:
    if word[:3] in ("par", "col", "tap"):
        return 3
    if len(word) > 1 and word[0] in VOWELS and word[1] in VOWELS:
        return min(3, len(word))
    return next((i + 1 for i in range(1, len(word)) if word[i] in VOWELS), len(word))


def stem_french(word: str) -> str:
    word = _marked(word)
    rv = _rv(word)
    r1, r2 = standard_regions(word, VOWELS)
    done, more = _suffix(word, rv, r1, r2)
    if done == word or more:
        verb = _verb(done, rv, r2)
        changed = verb != done or done != word
        done = verb
    else:
        changed = True
    if changed:
        done = done[:-1] + {"Y": "i", "ç": "c"}.get(done[-1:], done[-1:])
    else:
        done = _rest(done, rv, r2)
    if longest(done, ("enn", "onn", "ett", "ell", "eill")) is not None:
        done = done[:-1]
    at = len(done)
    while at and done[at - 1] not in VOWELS:
        at -= 1
    if 0 < at < len(done) and done[at - 1] in "éè":
        done = done[: at - 1] + "e" + done[at:]
    return done.lower()


def _suffix(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """The word after the first step, and whether verb endings are looked at all the same."""
    end = longest(word, STEP_1)
    if end is None:
        return word, False
    rest = word[: -len(end)]
    at = len(rest)
    inside = lambda text, part, region: text.endswith(part) and len(text) - len(part) >= region

    def cut(text: str, part: str, other: str | None = None) -> str:
        """text without part in R2; with `other` in its place where it is not in R2."""
        if not text.endswith(part):
            return text
        if len(text) - len(part) >= r2:
            return text[: -len(part)]
        return text if other is None else text[: -len(part)] + other

    if end in ADVERBS:
        return (rest + ADVERBS[end], True) if at >= rv else (word, True)
    if end in ("ment", "ments"):
        return (rest, True) if rest[-1:] in VOWELS and at - 1 >= rv else (word, True)
    if end in ("ement", "ements"):
        if at < rv:
            return word, False
        if rest.endswith("iv"):
            less = cut(rest, "iv")
            return (cut(less, "at") if less != rest else rest), False
        if rest.endswith("eus"):
            return (rest[:-3] if inside(rest, "eus", r2) else rest[:-3] + "eux" if inside(rest, "eus", r1) else rest), False
        if rest.endswith(("abl", "iqU")):
            return cut(rest, rest[-3:]), False
        if rest.endswith(("ièr", "Ièr")) and at - 3 >= rv:
            return rest[:-3] + "i", False
        return rest, False
    if end == "eaux":
        return rest + "eau", False
    if end == "aux":
        return (rest + "al" if at >= r1 else word), False
    if end in ("euse", "euses"):
        return (rest if at >= r2 else rest + "eux" if at >= r1 else word), False
    if end in ("issement", "issements"):
        return (rest if at >= r1 and rest[-1:] not in VOWELS else word), False
    if at < r2:
        return word, False
    if end in CHANGED:
        return rest + CHANGED[end], False
    if end in ACTIONS:
        return cut(rest, "ic", "iqU"), False
    if end in ("ité", "ités"):
        if rest.endswith("abil"):
            return cut(rest, "abil", "abl"), False
        if rest.endswith("ic"):
            return cut(rest, "ic", "iqU"), False
        return cut(rest, "iv"), False
    if end in ("if", "ive", "ifs", "ives"):
        less = cut(rest, "at")
        return (cut(less, "ic", "iqU") if less != rest else rest), False
    return rest, False


def _verb(word: str, rv: int, r2: int) -> str:
    tail = word[rv:]
    end = longest(tail, I_VERBS)
    if end is not None:
        before = tail[: -len(end)][-1:]
        if before and before not in VOWELS:
            return word[: -len(end)]
    end = longest(tail, ["ions", *E_VERBS, *A_VERBS])
    if end is None:
        return word
    rest = word[: -len(end)]
    if end == "ions":
        return rest if len(rest) >= r2 else word
    if end in A_VERBS and rest.endswith("e") and len(rest) - 1 >= rv:
        return rest[:-1]
    return rest


def _rest(word: str, rv: int, r2: int) -> str:
    if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
        word = word[:-1]
    end = longest(word[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
    if end is None:
        return word
    rest = word[: -len(end)]
    if end == "ion":
        return rest if len(rest) >= r2 and rest[-1:] in ("s", "t") and len(rest) - 1 >= rv else word
    if end == "e":
        return rest
    if end == "ë":
        return rest if rest.endswith("gu") else word
    return rest + "i"
