"""Snowball stemmers of seven more languages, written from the published algorithms.

Each takes a lower-case word.  Endings are fixed values of the algorithms.
"""

from __future__ import annotations

from .regions import cut, longest, region, verb_region

# -- Scandinavian languages ----------------------------------------------------


def _scandinavian_region(word: str, vowels: str) -> int:
    """The region behind the first syllable, three letters from the start or more."""
    return max(region(word, vowels), 3) if len(word) >= 3 else len(word)


def _drop_last(word: str, start: int, pairs) -> str:
    """The word without its last letter, if it ends in one of the pairs behind start."""
    return word[:-1] if longest(word[start:], pairs) else word


_SV_VOWELS = "aeiouyäåö"
_SV_BEFORE_S = "bcdfghjklmnoprtvy"
_SV_ENDINGS = (
    "a", "arna", "erna", "heterna", "orna", "ad", "e", "ade", "ande", "arne", "are", "aste", "en",
    "anden", "aren", "heten", "ern", "ar", "er", "heter", "or", "as", "arnas", "ernas", "ornas", "es",
    "ades", "andes", "ens", "arens", "hetens", "erns", "at", "andet", "het", "ast",
)


def swedish(word: str) -> str:
    r1 = _scandinavian_region(word, _SV_VOWELS)
    end = longest(word[r1:], _SV_ENDINGS + ("s",))
    if end and (end != "s" or word[-2] in _SV_BEFORE_S):
        word = word[: -len(end)]
    word = _drop_last(word, r1, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"))
    end = longest(word[r1:], ("lig", "ig", "els", "löst", "fullt"))
    if end in ("löst", "fullt"):
        return word[:-1]
    return word[: -len(end)] if end else word


_NO_VOWELS = "aeiouyæåø"
_NO_BEFORE_S = "bcdfghjlmnoprtvyz"
_NO_ENDINGS = (
    "a", "e", "ede", "ande", "ende", "ane", "ene", "hetene", "en", "heten", "ar", "er", "heter", "as",
    "es", "edes", "endes", "enes", "hetenes", "ens", "hetens", "ers", "ets", "et", "het", "ast",
)


def norwegian(word: str) -> str:
    r1 = _scandinavian_region(word, _NO_VOWELS)
    end = longest(word[r1:], _NO_ENDINGS + ("s", "erte", "ert"))
    if end in ("erte", "ert"):
        word = word[: -len(end)] + "er"
    elif end == "s":
        if word[-2] in _NO_BEFORE_S or (word[-2] == "k" and word[-3] not in _NO_VOWELS):
            word = word[:-1]
    elif end:
        word = word[: -len(end)]
    word = _drop_last(word, r1, ("dt", "vt"))
    end = longest(
        word[r1:], ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov")
    )
    return word[: -len(end)] if end else word


_DA_VOWELS = "aeiouyæåø"
_DA_BEFORE_S = "abcdfghjklmnoprtvyzå"
_DA_ENDINGS = (
    "hed", "ethed", "ered", "e", "erede", "ende", "erende", "ene", "erne", "ere", "en", "heden", "eren",
    "er", "heder", "erer", "heds", "es", "endes", "erendes", "enes", "ernes", "eres", "ens", "hedens",
    "erens", "ers", "ets", "erets", "et", "eret",
)
_DA_PAIRS = ("gd", "dt", "gt", "kt")


def danish(word: str) -> str:
    r1 = _scandinavian_region(word, _DA_VOWELS)
    end = longest(word[r1:], _DA_ENDINGS + ("s",))
    if end and (end != "s" or word[-2] in _DA_BEFORE_S):
        word = word[: -len(end)]
    word = _drop_last(word, r1, _DA_PAIRS)
    if word.endswith("igst"):
        word = word[:-2]
    end = longest(word[r1:], ("ig", "lig", "elig", "els", "løst"))
    if end == "løst":
        word = word[:-1]
    elif end:
        word = _drop_last(word[: -len(end)], r1, _DA_PAIRS)
    if len(word) > max(r1, 1) and word[-1] not in _DA_VOWELS and word[-1] == word[-2]:
        word = word[:-1]
    return word


# -- Dutch ---------------------------------------------------------------------

_NL_VOWELS = "aeiouyè"
_NL_PLAIN = str.maketrans("äëïöüáéíóú", "aeiouaeiou")


def _nl_undouble(word: str) -> str:
    return word[:-1] if word.endswith(("kk", "dd", "tt")) else word


def _nl_en(word: str, end: str, r1: int) -> str:
    """Without a plural ending, unless a vowel or ``gem`` stands before it."""
    before = cut(word, end, r1)
    if before == word or not before or before[-1] in _NL_VOWELS or before.endswith("gem"):
        return word
    return _nl_undouble(before)


def _nl_e(word: str, r1: int) -> str:
    before = cut(word, "e", r1)
    if before == word or not before or before[-1] in _NL_VOWELS:
        return word
    return _nl_undouble(before)


def dutch(word: str) -> str:
    letters = list(word.translate(_NL_PLAIN))
    for i, c in enumerate(letters):
        after = i > 0 and letters[i - 1] in _NL_VOWELS
        if c == "y" and (i == 0 or after):
            letters[i] = "Y"
        elif c == "i" and after and i + 1 < len(letters) and letters[i + 1] in _NL_VOWELS:
            letters[i] = "I"
    word = "".join(letters)
    r1 = region(word, _NL_VOWELS)
    r2 = region(word, _NL_VOWELS, r1)
    r1 = max(r1, 3)

    end = longest(word, ("heden", "ene", "en", "se", "s"))
    if end == "heden":
        before = cut(word, end, r1)
        word = before + "heid" if before != word else word
    elif end in ("ene", "en"):
        word = _nl_en(word, end, r1)
    elif end:
        before = cut(word, end, r1)
        if before and before != word and before[-1] not in _NL_VOWELS + "j":
            word = before
    with_e, word = word, _nl_e(word, r1)
    lost_e = word != with_e
    if word.endswith("heid") and not word.endswith("cheid"):
        before = cut(word, "heid", r2)
        if before != word:
            word = _nl_en(before, "en", r1) if before.endswith("en") else before
    end = longest(word, ("end", "ing", "ig", "lijk", "baar", "bar"))
    before = cut(word, end, r2)
    if before != word:
        if end in ("end", "ing"):
            inner = cut(before, "ig", r2)
            word = inner if inner != before and not inner.endswith("e") else _nl_undouble(before)
        elif end == "ig":
            word = word if before.endswith("e") else before
        elif end == "lijk":
            word = _nl_e(before, r1)
        elif end == "baar" or lost_e:
            word = before
    if (
        len(word) >= 4
        and word[-1] not in _NL_VOWELS + "I"
        and word[-3:-1] in ("aa", "ee", "oo", "uu")
        and word[-4] not in _NL_VOWELS
    ):
        word = word[:-2] + word[-1]
    return word.lower()


# -- Italian -------------------------------------------------------------------

_IT_VOWELS = "aeiouàèìòù"
_IT_GRAVE = str.maketrans("áéíóú", "àèìòù")
_IT_PRONOUNS = (
    "ci", "gli", "la", "le", "li", "lo", "mi", "ne", "si", "ti", "vi", "sene", "gliela", "gliele",
    "glieli", "glielo", "gliene", "mela", "mele", "meli", "melo", "mene", "tela", "tele", "teli", "telo",
    "tene", "cela", "cele", "celi", "celo", "cene", "vela", "vele", "veli", "velo", "vene",
)
_IT_STEP1 = {
    "": ("anza", "anze", "ico", "ici", "ica", "ice", "iche", "ichi", "ismo", "ismi", "abile", "abili",
         "ibile", "ibili", "ista", "iste", "isti", "istà", "istè", "istì", "oso", "osi", "osa", "ose",
         "mente", "atrice", "atrici", "ante", "anti"),
    "ic": ("azione", "azioni", "atore", "atori"),
    "log": ("logia", "logie"),
    "u": ("uzione", "uzioni", "usione", "usioni"),
    "ente": ("enza", "enze"),
    "amento": ("amento", "amenti", "imento", "imenti"),
    "amente": ("amente",),
    "ità": ("ità",),
    "ivo": ("ivo", "ivi", "iva", "ive"),
}
_IT_KIND = {e: kind for kind, ends in _IT_STEP1.items() for e in ends}
_IT_VERB = (
    "ammo", "ando", "ano", "are", "arono", "asse", "assero", "assi", "assimo", "ata", "ate", "ati", "ato",
    "ava", "avamo", "avano", "avate", "avi", "avo", "emmo", "enda", "ende", "endi", "endo", "erà", "erai",
    "eranno", "ere", "erebbe", "erebbero", "erei", "eremmo", "eremo", "ereste", "eresti", "erete", "erò",
    "erono", "essero", "ete", "eva", "evamo", "evano", "evate", "evi", "evo", "Yamo", "iamo", "immo",
    "irà", "irai", "iranno", "ire", "irebbe", "irebbero", "irei", "iremmo", "iremo", "ireste", "iresti",
    "irete", "irò", "irono", "isca", "iscano", "isce", "isci", "isco", "iscono", "issero", "ita", "ite",
    "iti", "ito", "iva", "ivamo", "ivano", "ivate", "ivi", "ivo", "ono", "uta", "ute", "uti", "uto", "ar",
    "ir",
)


def italian(word: str) -> str:
    letters = list(word.translate(_IT_GRAVE).replace("qu", "qU"))
    for i in range(1, len(letters) - 1):
        if letters[i] in "ui" and letters[i - 1] in _IT_VOWELS and letters[i + 1] in _IT_VOWELS:
            letters[i] = letters[i].upper()
    word = "".join(letters)
    rv = verb_region(word, _IT_VOWELS)
    r1 = region(word, _IT_VOWELS)
    r2 = region(word, _IT_VOWELS, r1)

    pronoun = longest(word, _IT_PRONOUNS)
    if pronoun:
        before = word[: -len(pronoun)]
        verb = longest(before, ("ando", "endo", "ar", "er", "ir"))
        if verb and len(before) - len(verb) >= rv:
            word = before if verb in ("ando", "endo") else before + "e"
    original, end = word, longest(word, _IT_KIND)
    if end:
        kind = _IT_KIND[end]
        before = cut(word, end, {"amento": rv, "amente": r1}.get(kind, r2))
        if before != word:
            word = before
            if kind == "ic":
                word = cut(word, "ic", r2)
            elif kind in ("log", "u", "ente"):
                word += kind
            elif kind == "amente":
                word = cut(word, "iv", r2)
                if word != before:
                    word = cut(word, "at", r2)
                else:
                    word = cut(word, longest(word, ("os", "ic", "abil")), r2)
            elif kind == "ità":
                word = cut(word, longest(word, ("abil", "ic", "iv")), r2)
            elif kind == "ivo":
                word = cut(word, "at", r2)
                if word != before:
                    word = cut(word, "ic", r2)
    if word == original:
        word = cut(word, longest(word[rv:], _IT_VERB), rv)
    if word and word[-1] in "aeioàèìò" and len(word) > rv:
        word = cut(word[:-1], "i", rv)
    if word.endswith(("ch", "gh")) and len(word) - 2 >= rv:
        word = word[:-1]
    return word.lower()


# -- Portuguese ----------------------------------------------------------------

_PT_VOWELS = "aeiouáéíóúâêô"
_PT_STEP1 = {
    "": ("eza", "ezas", "ico", "ica", "icos", "icas", "ismo", "ismos", "ável", "ível", "ista", "istas",
         "oso", "osa", "osos", "osas", "amento", "amentos", "imento", "imentos", "adora", "ador", "aça~o",
         "adoras", "adores", "aço~es", "ante", "antes", "ância"),
    "log": ("logia", "logias"),
    "u": ("uça~o", "uço~es"),
    "ente": ("ência", "ências"),
    "amente": ("amente",),
    "mente": ("mente",),
    "idade": ("idade", "idades"),
    "iva": ("iva", "ivo", "ivas", "ivos"),
    "ira": ("ira", "iras"),
}
_PT_KIND = {e: kind for kind, ends in _PT_STEP1.items() for e in ends}
_PT_VERB = (
    "ada", "ida", "ia", "aria", "eria", "iria", "ará", "ara", "erá", "era", "irá", "ava", "asse", "esse",
    "isse", "aste", "este", "iste", "ei", "arei", "erei", "irei", "am", "iam", "ariam", "eriam", "iriam",
    "aram", "eram", "iram", "avam", "em", "arem", "erem", "irem", "assem", "essem", "issem", "ado", "ido",
    "ando", "endo", "indo", "ara~o", "era~o", "ira~o", "ar", "er", "ir", "as", "adas", "idas", "ias",
    "arias", "erias", "irias", "arás", "aras", "erás", "eras", "irás", "avas", "es", "ardes", "erdes",
    "irdes", "ares", "eres", "ires", "asses", "esses", "isses", "astes", "estes", "istes", "is", "ais",
    "eis", "íeis", "aríeis", "eríeis", "iríeis", "áreis", "areis", "éreis", "ereis", "íreis", "ireis",
    "ásseis", "ésseis", "ísseis", "áveis", "ados", "idos", "ámos", "amos", "íamos", "aríamos", "eríamos",
    "iríamos", "áramos", "éramos", "íramos", "ávamos", "emos", "aremos", "eremos", "iremos", "ássemos",
    "êssemos", "íssemos", "imos", "armos", "ermos", "irmos", "eu", "iu", "ou", "ira", "iras",
)


def _pt_suffix(word: str, rv: int, r1: int, r2: int) -> str:
    end = longest(word, _PT_KIND)
    if not end:
        return word
    kind = _PT_KIND[end]
    before = cut(word, end, {"amente": r1, "ira": rv}.get(kind, r2))
    if before == word:
        return word
    if kind == "ira":
        return before + "ir" if before.endswith("e") else word
    if kind in ("log", "u", "ente"):
        return before + kind
    if kind == "amente":
        without = cut(before, "iv", r2)
        if without != before:
            return cut(without, "at", r2)
        return cut(before, longest(before, ("os", "ic", "ad")), r2)
    if kind == "mente":
        return cut(before, longest(before, ("ante", "avel", "ível")), r2)
    if kind == "idade":
        return cut(before, longest(before, ("abil", "ic", "iv")), r2)
    if kind == "iva":
        return cut(before, "at", r2)
    return before


def portuguese(word: str) -> str:
    word = word.replace("ã", "a~").replace("õ", "o~")
    rv = verb_region(word, _PT_VOWELS)
    r1 = region(word, _PT_VOWELS)
    r2 = region(word, _PT_VOWELS, r1)
    original, word = word, _pt_suffix(word, rv, r1, r2)
    if word == original:
        word = cut(word, longest(word[rv:], _PT_VERB), rv)
    if word != original:
        if word.endswith("ci") and len(word) > rv:
            word = word[:-1]
    else:
        word = cut(word, longest(word, ("os", "a", "i", "o", "á", "í", "ó")), rv)
    if word.endswith(("e", "é", "ê")):
        if len(word) > rv:
            word = word[:-1]
            if word.endswith(("gu", "ci")) and len(word) > rv:
                word = word[:-1]
    elif word.endswith("ç"):
        word = word[:-1] + "c"
    return word.replace("a~", "ã").replace("o~", "õ")


# -- Russian -------------------------------------------------------------------

_RU_VOWELS = "аеиоуыэюя"
#: Endings that count only behind а or я, and endings that always count.
_RU_GERUND_A = ("в", "вши", "вшись")
_RU_GERUND = ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись")
_RU_ADJECTIVE = (
    "ее", "ие", "ые", "ое", "ими", "ыми", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "его", "ого",
    "ему", "ому", "их", "ых", "ую", "юю", "ая", "яя", "ою", "ею",
)
_RU_PARTICIPLE_A = ("ем", "нн", "вш", "ющ", "щ")
_RU_PARTICIPLE = ("ивш", "ывш", "ующ")
_RU_VERB_A = (
    "ла", "на", "ете", "йте", "ли", "й", "л", "ем", "н", "ло", "но", "ет", "ют", "ны", "ть", "ешь", "нно",
)
_RU_VERB = (
    "ила", "ыла", "ена", "ейте", "уйте", "ите", "или", "ыли", "ей", "уй", "ил", "ыл", "им", "ым", "ен",
    "ило", "ыло", "ено", "ят", "ует", "уют", "ит", "ыт", "ены", "ить", "ыть", "ишь", "ую", "ю",
)
_RU_NOUN = (
    "а", "ев", "ов", "ие", "ье", "е", "иями", "ями", "ами", "еи", "ии", "и", "ией", "ей", "ой", "ий", "й",
    "иям", "ям", "ием", "ем", "ам", "ом", "о", "у", "ах", "иях", "ях", "ы", "ь", "ию", "ью", "ю", "ия",
    "ья", "я",
)


def _ru_cut(part: str, behind_a=(), always=()) -> str:
    """Without the longest ending; one of the first kind stays where no а or я stands before it."""
    end = longest(part, (*behind_a, *always))
    before = part[: len(part) - len(end)]
    return part if end in behind_a and not before.endswith(("а", "я")) else before


def russian(word: str) -> str:
    word = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(word) if c in _RU_VOWELS), len(word))
    r2 = region(word, _RU_VOWELS, region(word, _RU_VOWELS))
    head, part = word[:rv], word[rv:]
    without = _ru_cut(part, _RU_GERUND_A, _RU_GERUND)
    if without == part:
        part = _ru_cut(part, always=("ся", "сь"))
        without = _ru_cut(part, always=_RU_ADJECTIVE)
        if without != part:
            without = _ru_cut(without, _RU_PARTICIPLE_A, _RU_PARTICIPLE)
        else:
            without = _ru_cut(part, _RU_VERB_A, _RU_VERB)
            if without == part:
                without = _ru_cut(part, always=_RU_NOUN)
    part = without
    part = part[:-1] if part.endswith("и") else part
    part = cut(part, longest(part, ("ость", "ост")), r2 - rv)
    end = longest(part, ("ейше", "ейш", "нн", "ь"))
    if end == "нн":
        part = part[:-1]
    elif end:
        part = part[: -len(end)]
        if end != "ь" and part.endswith("нн"):
            part = part[:-1]
    return head + part
