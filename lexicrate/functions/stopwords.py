"""Stopwords of 21 languages."""

#: Changing them changes which terms are indexed.
STOPWORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "is", "at", "which", "on", "a", "an", "and", "of"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une"),
    "de": ("der", "die", "das", "und", "ein", "eine", "mit"),
    "es": ("el", "la", "los", "las", "de", "y", "un", "una"),
    "pt": ("o", "a", "os", "as", "de", "e", "um", "uma"),
    "it": ("il", "lo", "la", "gli", "le", "di", "e", "un"),
    "nl": ("de", "het", "een", "en", "van", "op", "in"),
    "ru": ("и", "в", "во", "не", "что", "он", "на"),
    "ar": ("و", "في", "من", "على", "أن", "إلى"),
    "hi": ("और", "का", "के", "में", "से", "पर", "यह"),
    "zh": ("的", "了", "在", "是", "和", "有"),
    "ja": ("の", "に", "は", "を", "た", "が"),
    "ko": ("의", "에", "이", "가", "은", "는"),
    "sv": ("och", "det", "att", "i", "en", "som"),
    "da": ("og", "i", "jeg", "det", "at", "en"),
    "no": ("og", "i", "jeg", "det", "at", "en"),
    "fi": ("ja", "on", "se", "että", "ei", "kun"),
    "ro": ("și", "în", "la", "de", "un", "o"),
    "tr": ("ve", "bir", "bu", "için", "ile", "de"),
    "pl": ("i", "w", "na", "to", "z", "że"),
    "cs": ("a", "v", "je", "na", "se", "to"),
}


def stopwords(lang: str) -> tuple[str, ...]:
    """The words of a language; none for a language that isn't listed."""
    return STOPWORDS.get(lang, ())


def supported_stopword_languages() -> set[str]:
    return set(STOPWORDS)
