"""Snowball stemmers, written from the published algorithms.

English is the revised Porter algorithm; German, French and Spanish follow their
Snowball descriptions, as do the languages of ``stemming_more``.  A name that is no
language gets the English one.
"""

from __future__ import annotations

from collections.abc import Callable

from ..config import NoOp, Porter, Setting, Snowball
from ..errors import TokenizerError
from .regions import longest as _longest
from .regions import region as _region
from .regions import verb_region as _rv
from .stemming_more import danish, dutch, italian, norwegian, portuguese, russian, swedish

# -- English -------------------------------------------------------------------

_EN_VOWELS = "aeiouy"
#: Fixed values of the algorithm.
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_KEEP = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_EN_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
_EN_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)


def _en_short_end(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _EN_VOWELS and word[1] not in _EN_VOWELS
    return (
        len(word) > 2
        and word[-1] not in _EN_VOWELS + "wxY"
        and word[-2] in _EN_VOWELS
        and word[-3] not in _EN_VOWELS
    )


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_SPECIAL:
        return _EN_SPECIAL[word]
    word = word.replace("’", "'").removeprefix("'")
    marked = [
        "Y" if c == "y" and (i == 0 or word[i - 1] in _EN_VOWELS) else c for i, c in enumerate(word)
    ]
    word = "".join(marked)
    start = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = start if start is not None else _region(word, _EN_VOWELS)
    r2 = _region(word, _EN_VOWELS, r1)
    # 0 and 1a
    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))
    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and any(c in _EN_VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _EN_KEEP:
        return word
    # 1b
    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: -len(end)] + "ee"
    elif end and any(c in _EN_VOWELS for c in word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(_EN_DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _en_short_end(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _EN_VOWELS:
        word = word[:-1] + "i"
    # 2
    end = _longest(word, _EN_STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if end == "li":
            word = before if before.endswith(tuple("cdeghkmnrt")) else word
        elif end == "ogi":
            word = before + "og" if before.endswith("l") else word
        else:
            word = before + _EN_STEP2[end]
    # 3
    end = _longest(word, _EN_STEP3)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + _EN_STEP3[end]
    # 4
    end = _longest(word, _EN_STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    # 5
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or (at >= r1 and not _en_short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


# -- German --------------------------------------------------------------------

_DE_VOWELS = "aeiouyäöü"


def german(word: str) -> str:
    word = word.replace("ß", "ss")
    word = "".join(
        c.upper() if c in "uy" and 0 < i < len(word) - 1 and word[i - 1] in _DE_VOWELS and word[i + 1] in _DE_VOWELS else c
        for i, c in enumerate(word)
    )
    first = _region(word, _DE_VOWELS)
    r1, r2 = max(first, 3), _region(word, _DE_VOWELS, first)
    end = _longest(word, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(word) - len(end) >= r1:
        if end == "s":
            word = word[:-1] if word[:-1].endswith(tuple("bdfghklmnrt")) else word
        else:
            word = word[: -len(end)]
            if end in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
    end = _longest(word, ("en", "er", "est", "st"))
    if end and len(word) - len(end) >= r1:
        if end != "st":
            word = word[: -len(end)]
        elif len(word) > 5 and word[-3] in "bdfghklmnt":
            word = word[:-2]
    end = _longest(word, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and len(word) - len(end) >= r2:
        before = word[: -len(end)]
        inside = lambda part: before.endswith(part) and len(before) - len(part) >= r2
        if end in ("end", "ung"):
            word = before
            if inside("ig") and not before[:-2].endswith("e"):
                word = before[:-2]
        elif end in ("ig", "ik", "isch"):
            word = word if before.endswith("e") else before
        elif end in ("lich", "heit"):
            word = before
            part = _longest(before, ("er", "en"))
            if part and len(before) - len(part) >= r1:
                word = before[:-2]
        else:
            word = before
            part = _longest(before, ("lich", "ig"))
            if part and inside(part):
                word = before[: -len(part)]
    return word.lower().translate(str.maketrans("äöü", "aou"))


# -- Spanish -------------------------------------------------------------------

_ES_VOWELS = "aeiouáéíóúü"
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
#: Fixed values of the algorithm.
_ES_PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
_ES_STEP1 = {
    "": ("anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible",
         "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos"),
    "ic": ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias", "acion"),
    "log": ("logía", "logías"),
    "u": ("ución", "uciones", "ucion"),
    "ente": ("encia", "encias"),
    "amente": ("amente",),
    "mente": ("mente",),
    "idad": ("idad", "idades"),
    "iva": ("iva", "ivo", "ivas", "ivos"),
}
_ES_KIND = {e: kind for kind, ends in _ES_STEP1.items() for e in ends}
_ES_Y = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
_ES_VERB_E = ("en", "es", "éis", "emos")
_ES_VERB = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré",
    "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré",
    "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste",
    "an", "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando",
    "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases",
    "ieses", "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis",
    "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)


def spanish(word: str) -> str:
    rv = _rv(word, _ES_VOWELS)
    r1 = _region(word, _ES_VOWELS)
    r2 = _region(word, _ES_VOWELS, r1)
    pronoun = _longest(word, _ES_PRONOUNS)
    if pronoun and len(word) - len(pronoun) >= rv:
        before = word[: -len(pronoun)]
        verb = _longest(before, ("iéndo", "ándo", "ár", "ér", "ír", "iendo", "ando", "ar", "er", "ir", "yendo"))
        if verb and len(before) - len(verb) >= rv:
            if verb in ("iéndo", "ándo", "ár", "ér", "ír"):
                word = before[: -len(verb)] + verb.translate(_ES_PLAIN)
            elif verb != "yendo" or before[:-5].endswith("u"):
                word = before
    original, end = word, _longest(word, _ES_KIND)
    if end:
        kind, before = _ES_KIND[end], word[: -len(end)]
        at, drop = len(before), lambda w, e: w[: -len(e)] if e and w.endswith(e) and len(w) - len(e) >= r2 else w
        if kind == "amente" and at >= r1:
            word = drop(before, "iv")
            word = drop(word, "at") if word != before else drop(before, _longest(before, ("os", "ic", "ad")))
        elif kind != "amente" and at >= r2:
            word = before
            if kind == "ic":
                word = drop(word, "ic")
            elif kind in ("log", "u", "ente"):
                word += kind
            elif kind == "mente":
                word = drop(word, _longest(word, ("ante", "able", "ible")))
            elif kind == "idad":
                word = drop(word, _longest(word, ("abil", "ic", "iv")))
            elif kind == "iva":
                word = drop(word, "at")
    if word == original:
        end = _longest(word[rv:], _ES_Y)
        if end and word[: -len(end)].endswith("u"):
            word = word[: -len(end)]
        else:
            end = _longest(word[rv:], _ES_VERB + _ES_VERB_E)
            if end:
                word = word[: -len(end)]
                if end in _ES_VERB_E and word.endswith("gu"):
                    word = word[:-1]
    end = _longest(word[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if end:
        word = word[: -len(end)]
        if end in ("e", "é") and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word.translate(_ES_PLAIN)


# -- French --------------------------------------------------------------------

_FR_VOWELS = "aeiouyâàëéêèïîôûù"
#: Fixed values of the algorithm.
_FR_STEP1 = {
    "ance": ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"),
    "atrice": ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"),
    "logie": ("logie", "logies"),
    "usion": ("usion", "ution", "usions", "utions"),
    "ence": ("ence", "ences"),
    "ement": ("ement", "ements"),
    "ité": ("ité", "ités"),
    "if": ("if", "ive", "ifs", "ives"),
    "eaux": ("eaux",), "aux": ("aux",), "euse": ("euse", "euses"),
    "issement": ("issement", "issements"),
    "amment": ("amment",), "emment": ("emment",), "ment": ("ment", "ments"),
}
_FR_KIND = {e: kind for kind, ends in _FR_STEP1.items() for e in ends}
_FR_I_VERB = (
    "îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras",
    "irent", "irez", "iriez", "irions", "irons", "iront", "is", "issaIent", "issais", "issait",
    "issant", "issante", "issantes", "issants", "isse", "issent", "isses", "issez", "issiez",
    "issions", "issons", "it",
)
_FR_E_VERB = (
    "é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez",
    "eriez", "erions", "erons", "eront", "ez", "iez",
)
_FR_A_VERB = (
    "âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as",
    "asse", "assent", "asses", "assiez", "assions",
)


def french(word: str) -> str:
    chars = list(word)
    for i, c in enumerate(word):
        before = word[i - 1] if i else ""
        after = word[i + 1] if i + 1 < len(word) else ""
        beside = (before != "" and before in _FR_VOWELS, after != "" and after in _FR_VOWELS)
        if c in "ui" and all(beside) or c == "u" and before == "q" or c == "y" and any(beside):
            chars[i] = c.upper()
    word = "".join(chars)
    if word[:2] and len(word) >= 2 and word[0] in _FR_VOWELS and word[1] in _FR_VOWELS:
        rv = min(3, len(word))
    elif word.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(word)) if word[i] in _FR_VOWELS), len(word))
    r1 = _region(word, _FR_VOWELS)
    r2 = _region(word, _FR_VOWELS, r1)
    original, verbs = word, False
    in2 = lambda w, e: bool(e) and w.endswith(e) and len(w) - len(e) >= r2
    end = _longest(word, _FR_KIND)
    kind, before = _FR_KIND.get(end, ""), word[: len(word) - len(end)]
    at = len(before)
    if kind == "ance" and at >= r2:
        word = before
    elif kind == "atrice" and at >= r2:
        word = before
        if word.endswith("ic"):
            word = word[:-2] if in2(word, "ic") else word[:-2] + "iqU"
    elif kind == "logie" and at >= r2:
        word = before + "log"
    elif kind == "usion" and at >= r2:
        word = before + "u"
    elif kind == "ence" and at >= r2:
        word = before + "ent"
    elif kind == "ement" and at >= rv:
        word = before
        part = _longest(word, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        if part == "iv" and in2(word, "iv"):
            word = word[:-2]
            word = word[:-2] if in2(word, "at") else word
        elif part == "eus":
            word = word[:-3] if in2(word, "eus") else word[:-1] + "x" if len(word) - 3 >= r1 else word
        elif part in ("abl", "iqU") and in2(word, part):
            word = word[: -len(part)]
        elif part in ("ièr", "Ièr") and len(word) - 3 >= rv:
            word = word[:-3] + "i"
    elif kind == "ité" and at >= r2:
        word = before
        part = _longest(word, ("abil", "ic", "iv"))
        if part == "abil":
            word = word[:-4] if in2(word, part) else word[:-4] + "abl"
        elif part == "ic":
            word = word[:-2] if in2(word, part) else word[:-2] + "iqU"
        elif part == "iv" and in2(word, part):
            word = word[:-2]
    elif kind == "if" and at >= r2:
        word = before
        if in2(word, "at"):
            word = word[:-2]
            if word.endswith("ic"):
                word = word[:-2] if in2(word, "ic") else word[:-2] + "iqU"
    elif kind == "eaux":
        word = before + "eau"
    elif kind == "aux" and at >= r1:
        word = before + "al"
    elif kind == "euse":
        word = before if at >= r2 else before + "eux" if at >= r1 else word
    elif kind == "issement" and at >= r1 and before and before[-1] not in _FR_VOWELS:
        word = before
    elif kind == "amment" and at >= rv:
        word, verbs = before + "ant", True
    elif kind == "emment" and at >= rv:
        word, verbs = before + "ent", True
    elif kind == "ment" and at - 1 >= rv and before[-1] in _FR_VOWELS:
        word, verbs = before, True
    if word == original or verbs:
        start = word
        end = _longest(word[rv:], _FR_I_VERB)
        if end and len(word) - len(end) - 1 >= rv and word[-len(end) - 1] not in _FR_VOWELS:
            word = word[: -len(end)]
        else:
            end = _longest(word[rv:], (*_FR_E_VERB, *_FR_A_VERB, "ions"))
            if end == "ions":
                word = word[:-4] if in2(word, "ions") else word
            elif end in _FR_E_VERB:
                word = word[: -len(end)]
            elif end:
                word = word[: -len(end)]
                if word.endswith("e") and len(word) - 1 >= rv:
                    word = word[:-1]
        changed = word != start or (word != original and not verbs)
    else:
        changed = True
    if changed and word != original:
        if word.endswith("Y"):
            word = word[:-1] + "i"
        elif word.endswith("ç"):
            word = word[:-1] + "c"
    elif not changed:
        if word.endswith("s") and len(word) > 1 and word[-2] not in "aiouès":
            word = word[:-1]
        end = _longest(word[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e"))
        if end == "ion":
            if in2(word, "ion") and len(word) - 4 >= rv and word[-4] in "st":
                word = word[:-3]
        elif end == "e":
            word = word[:-1]
        elif end:
            word = word[: -len(end)] + "i"
    if word.endswith(("enn", "onn", "ett", "ell", "eill")):
        word = word[:-1]
    for i in range(len(word) - 1, -1, -1):
        if word[i] in _FR_VOWELS:
            if word[i] in "éè" and i < len(word) - 1:
                word = word[:i] + "e" + word[i + 1 :]
            break
    return word.lower()


STEMMERS: dict[str, Callable[[str], str]] = {
    "en": english, "de": german, "es": spanish, "fr": french,
    "da": danish, "nl": dutch, "it": italian, "no": norwegian, "pt": portuguese, "ru": russian, "sv": swedish,
}


#: Languages whose stemmers are not written; their words are never stemmed as English ones.
UNWRITTEN = {
    "ar": "Arabic", "fi": "Finnish", "hu": "Hungarian", "ro": "Romanian", "ta": "Tamil", "tr": "Turkish",
}


def stemmer_for(setting: Setting) -> Callable[[str], str] | None:
    """The function of a stemmer setting; None where nothing is to be done."""
    if isinstance(setting, NoOp):
        return None
    if isinstance(setting, Porter):
        return english
    if isinstance(setting, Snowball):
        if setting.lang in UNWRITTEN:
            raise TokenizerError(f"no stemmer for {UNWRITTEN[setting.lang]} yet")
        return STEMMERS.get(setting.lang, english)  # as for any name that is no language
    raise TokenizerError(f"not a stemmer: {setting}")
