"""Stemmers of more languages against stems that the published algorithms give."""

from __future__ import annotations

import pytest

from lexicrate.config import Snowball
from lexicrate.functions.stemming import STEMMERS, stemmer_for

VECTORS = {
    "sv": "jakten jakt jaktens jakt jaktkarlarne jaktkarl klokheten klok klokast klok klockan klockan "
          "klockor klock klostergården klostergård arbetslöst arbetslös friskt frisk s s is is",
    "no": "havnedistriktene havnedistrikt havnemyndigheter havnemynd opningen opning havnene havn sterkt sterkt "
          "fortalte fortalt vurderte vurder vurdert vurder",
    "da": "indtage indtag indtagelse indtag undersøgelser undersøg underviste undervist undgår undgår "
          "venligst ven arbejdsløst arbejdsløs",
    "nl": "lichamelijk licham lichamelijke licham lichamen licham opgegeven opgegev opgingen opging "
          "opglanzen opglanz oplossing oploss mogelijkheden mogelijk bomen bom boom bom maan man",
    "it": "abbandonata abbandon abbandonare abbandon abbandono abband pronto pront pronunciamento pronunc "
          "nazione nazion nazioni nazion bianche bianc laghi lagh mangiandolo mang",
    "pt": "boataria boat boato boat boas boas boca boc quilométricas quilométr quieta quiet bobagem bobag "
          "nações naçõ felicidade felic",
    "ru": "важная важн важнейшие важн падение паден вавиловка вавиловк читаешь чита прочитав прочита "
          "красивого красив новость новост книгами книг",
}


@pytest.mark.parametrize("lang", VECTORS)
def test_vectors(lang):
    words = VECTORS[lang].split()
    stem = stemmer_for(Snowball(lang))
    assert [stem(w) for w in words[::2]] == words[1::2]


@pytest.mark.parametrize("lang", sorted(STEMMERS))
def test_short_and_odd_words(lang):
    stem = STEMMERS[lang]
    for word in ("", "a", "s", "ss", "is", "ks", "e", "y", "ñ", "я", "1", "日本", "aaaaaaaa", "ssssssss"):
        assert isinstance(stem(word), str) and len(stem(word)) <= len(word)
