"""Spanish stems, after the published Snowball rules."""

from __future__ import annotations

from .regions import longest, standard_regions

VOWELS = frozenset("aeiouáéíóúü")
PLAIN = str.maketrans("áéíóú", "aeiou")

# The suffixes of each step.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_ACUTE = "iéndo ándo ár ér ír".split()
BEFORE = "ando iendo ar er ir".split()
DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
ACTIONS = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
CHANGED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
STEP_1 = [*DELETED, *ACTIONS, *CHANGED, "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"]
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_VERBS = "en es éis emos".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
    "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
    "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    first, second = word[0] in VOWELS, word[1] in VOWELS
    if first != second and not first:
        return 3
    stop = not second  # after the next vowel where the second letter is a consonant, else after the next consonant
    return next((i + 1 for i in range(2, len(word)) if (word[i] in VOWELS) == stop), len(word))


def stem_spanish(word: str) -> str:
    rv = _rv(word)
    r1, r2 = standard_regions(word, VOWELS)
    word = _pronoun(word, rv)
    done = _suffix(word, r1, r2)
    if done == word:
        done = _verb(word, rv)
    return _rest(done, rv).translate(PLAIN)


def _pronoun(word: str, rv: int) -> str:
    end = longest(word, PRONOUNS)
    if end is None or len(word) - len(end) < rv:
        return word
    rest = word[: -len(end)]
    for endings, change in ((BEFORE_ACUTE, True), (BEFORE, False)):
        verb = longest(rest, endings)
        if verb is not None and len(rest) - len(verb) >= rv:
            return rest[: -len(verb)] + verb.translate(PLAIN) if change else rest
    if rest.endswith("uyendo") and len(rest) - 5 >= rv:
        return rest
    return word


def _suffix(word: str, r1: int, r2: int) -> str:
    end = longest(word, STEP_1)
    if end is None:
        return word
    rest = word[: -len(end)]
    at = len(rest)

    def without(text: str, *ends: str) -> str:
        found = longest(text, ends)
        return text[: -len(found)] if found is not None and len(text) - len(found) >= r2 else text

    if end == "amente":
        if at < r1:
            return word
        if rest.endswith("iv"):
            less = without(rest, "iv")
            return without(less, "at") if less != rest else rest
        return without(rest, "os", "ic", "ad")
    if at < r2:
        return word
    if end in CHANGED:
        return rest + CHANGED[end]
    if end in ACTIONS:
        return without(rest, "ic")
    if end == "mente":
        return without(rest, "ante", "able", "ible")
    if end in ("idad", "idades"):
        return without(rest, "abil", "ic", "iv")
    if end in ("iva", "ivo", "ivas", "ivos"):
        return without(rest, "at")
    return rest


def _verb(word: str, rv: int) -> str:
    tail = word[rv:]
    end = longest(tail, Y_VERBS)
    if end is not None and word[: -len(end)].endswith("u"):
        return word[: -len(end)]
    end = longest(tail, [*GU_VERBS, *VERBS])
    if end is None:
        return word
    rest = word[: -len(end)]
    return rest[:-1] if end in GU_VERBS and rest.endswith("gu") else rest


def _rest(word: str, rv: int) -> str:
    end = longest(word[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end is None:
        return word
    rest = word[: -len(end)]
    return rest[:-1] if end in "eé" and rest.endswith("gu") and len(rest) - 1 >= rv else rest
