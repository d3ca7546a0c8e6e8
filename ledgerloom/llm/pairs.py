"""Defective question-answer pairs: labelling functions combined by an expectation-maximization label model.

For each defect several noisy labelling functions, each looking at another side of a pair (its marks, its
length, its words, its script ...), vote on it: +1 it has the defect, -1 it has not, 0 no opinion. Only the
counts of vote patterns leave the executors (at most 3**k for k functions). On them a naive Bayes model with
one hidden label per defect is fitted by EM, starting from the votes on labelled pairs and held near them by
pseudo-counts in proportion to the data; an abstention carries no weight. A pair gets every defect whose
posterior exceeds that defect's cutoff; cutoffs are chosen on other labelled pairs. Both sets (LABELLED,
VALIDATION) are written here and no part of the data.

Defects: ``empty`` (null, blanks, invisible characters, punctuation, a bare placeholder), ``truncated``
(breaks off in a word, phrase or open bracket), ``refusal`` (declines; the sentinel DONT-KNOW unless the
question is marked as a negative test), ``copies_question`` (nothing but the question's words, perhaps
repeated or marked), ``other_language``. A null question counts as empty text. Repeated rows count once.

All functions but those on languages are built-in column expressions. The script of a text is that of most
of its letters, of all scripts of Unicode; among languages of one script function words and a
character-trigram classifier vote, the latter fitted on a hashed sample of about SAMPLE pairs.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.runtime import written

DEFECTS = ("empty", "truncated", "refusal", "copies_question", "other_language")
#: Pairs on which the language classifier is fitted: about so many, never more than twice as many.
SAMPLE = 20_000

PLACEHOLDERS = "none null nil nan na n/a tbd tba todo empty missing undefined unknown blank void placeholder xxx fixme pending entfällt vide vacío нет なし 未定".split()
SENTINEL = "dont-know"
NEGATIVE_TEST = r"(?i)^[^\p{L}\p{N}]*negative[ -]?test\b[^\p{L}\p{N}¿]*"

# Function words by language; all are common and short.
FUNCTION_WORDS = {
    "en": "the of and is was it in to by that does not for on an which who when why how with from be can its this there are only after because has have been he she they before at as you i".split(),
    "de": "der die das und ist war es im zu von den dem mit nicht ein eine einen einem wird wurde wer wie warum für nach bei weil dann aus auf hat er sie zuletzt kann ich nichts diese leider darf".split(),
    "fr": "le la les et est de du des un une pour par dans qui que quel pourquoi il elle a été au aux avec sur ne pas ce cette sont je vous plus dans reste fermé depuis figure".split(),
    "es": "el la los las y es de del un una por para en que quién cuál cómo fue no con se lo su al sigue según son está tiene desde muy consta esa este puedo me".split(),
    "it": "il lo gli di della dello delle nel nella che non è sono con per perché dalla dal alla sul questo questa stato molto anche come dietro ogni dopo prima chi quanti ha".split(),
    "pt": "o os um uma do da dos das no na nos não com são foi que pelo pela ao à está seu sua mais muito também atrás porque quem depois".split(),
    "nl": "de het een van en is niet met op voor aan zijn wordt werd naar dat deze door maar ook achter omdat wie".split(),
    "ru": "и в не на с из у что как кто какой почему это был он она они за по от до его для после нём очень я на этот".split(),
}
WORD_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_words):
        WORD_LANGUAGES[_w] = (*WORD_LANGUAGES.get(_w, ()), _lang)

# Words after which no phrase ends, and Japanese particles.
OPEN_WORDS = (
    "the a an of and or in to by with from at on for that which is was are it before after because than into its as cannot "
    "der die das und oder ein eine einen einem einer von den dem mit nach bei weil im in zu zur zum aus auf für "
    "le la les et ou de du des un une pour par dans avec sur que qui en au aux l d "
    "el los las y o del un una por para en con que se al según su "
    "и в во на с со из у что как за по от до о об".split()
)
JA_PARTICLES = "が を は に で と の も へ から より て 、".split()

# What is said when an answer is declined: that one cannot or will not, what one will not do, and apologies.
UNWILLING = (
    r"can not|cannot|can['’]t|could not|couldn['’]t|won['’]t|will not|would not|unable|not able|decline|refuse to|not have enough|\S*n['’]t have (?:enough|any)|rather not|prefer not|not allowed|not permitted|outside what|prevent|prohibit|forbid|do not allow|no comment(?= (?:on|about|from) )|no comment(?= $)|ask someone else"
    "|kann ich|kann leider|darf ich|nicht beantworten|nichts sagen|nicht helfen|keine auskunft|keine angaben|leider nichts?"
    "|ne peux|ne suis pas|ne souhaite|pas en mesure|m['’]abstenir|préfère ne|impossible de|no puedo|no me está|prefiero no|no estoy autorizad|не могу|не вправе|не имею права|предпочту не"
)
UNWILLING_JA = "できません|られません|しかねます|控えさせ"
ACTS = (
    "help|answer|answering|assist|say|comment|discuss|provide|share|sharing|speculate|decline|fulfilled|processed"
    "|sagen|beantworten|helfen|auskunft|angaben|répondre|aider|m['’]abstenir|dire|responder|ayudar|contestar|hablar|decir|ответить|помочь|сказать|обсуждать"
)
ACTS_JA = "答え|手伝い|回答"
SELF = r"i|me|my|we|us|i['’]\S+|(?:this|that) (?:one|request|question|topic|matter)|ich|mir|je|j['’]\S+|moi|puedo|prefiero|estoy|siento|yo|me está|я|мне|могу|вправе"
EXCUSES = (
    "sorry|unfortunately|apologi[sz]e|regrettably|language model|guidelines|tut mir leid|leider|sprachmodell|désolé|malheureusement|regrette|modèle de langage|lo siento|lamentablemente|modelo de lenguaje"
    "|извините|к сожалению|простите|языковая модель"
)
EXCUSES_JA = "申し訳|残念ながら|恐れ入り|言語モデル"
# What others say is no refusal of one's own.
REPORTED = "says|said|states|stated|reads|sagt|sagte|dit que|dice|dijo|говорит|сказал|сказала"
TOLD = "says|said|states|stated|wrote|reads|according to|sagt|sagte|steht|dit que|selon|dice|según|говорит|сказал|until|unless|because|since"

LABELLED: tuple[tuple[str, str | None, str], ...] = (
    ("Which gate is open?", None, "empty"), ("Which gate is open?", "-", "empty"), ("Which gate is open?", "todo", "empty"), ("Welches Tor ist offen?", "n/a", "empty"), ("Quelle porte est ouverte ?", " ", "empty"), ("¿Qué puerta está abierta?", "???", "empty"), ("Who has the list?", "missing", "empty"),
    ("Which gate is open?", "The gate on the north side of the", "truncated"), ("Which gate is open?", "The north gate is open until nine and then clo", "truncated"), ("Which gate is open?", "It is the north gate (next to the", "truncated"), ("Welches Tor ist offen?", "Das Tor an der Nordseite wurde mit", "truncated"),
    ("Quelle porte est ouverte ?", "La porte du nord reste ouverte jus", "truncated"), ("¿Qué puerta está abierta?", "La puerta del norte está …", "truncated"), ("どの門が開いていますか？", "北の門は朝から", "truncated"), ("Какие ворота открыты?", "Северные ворота открыты до", "truncated"), ("Who has the list?", "The old cook of the house keeps", "truncated"), ("Who has the list?", "Marlow and the", "truncated"), ("どの門が開いていますか？", "北の門が", "truncated"), ("Welches Tor ist offen?", "das Tor mit der", "truncated"), ("Who has the list?", "It was last seen on day 12, shortly before", "truncated"), ("Can the gate be opened?", "It can be opened with the key that", "truncated"),
    ("Which gate is open?", "I'm sorry, I cannot answer that question.", "refusal"), ("Which gate is open?", "I can't help with this.", "refusal"), ("Which gate is open?", "I would rather not say anything about the gate.", "refusal"), ("Who has the list?", "That request can't be processed.", "refusal"), ("Who has the list?", "DONT-KNOW", "refusal"), ("Which gate is open?", "dont-know", "refusal"),
    ("Which gate is open?", "As a language model, I am not able to comment on gates.", "refusal"), ("Which gate is open?", "Our guidelines prevent me from sharing this.", "refusal"), ("Who has the list?", "I do not have enough information to say who has it.", "refusal"), ("Who has the list?", "No comment on that question.", "refusal"), ("Who has the list?", "Lists are outside what I am allowed to discuss.", "refusal"),
    ("Welches Tor ist offen?", "Diese Frage darf ich leider nicht beantworten.", "refusal"), ("Welches Tor ist offen?", "Leider kann ich dazu keine Auskunft geben.", "refusal"), ("Quelle porte est ouverte ?", "Je ne suis pas en mesure de répondre.", "refusal"), ("¿Qué puerta está abierta?", "No puedo responder a eso.", "refusal"), ("Какие ворота открыты?", "Я не вправе это обсуждать.", "refusal"), ("どの門が開いていますか？", "その質問にはお答えできません。", "refusal"),
    ("Which gate is open?", "Which gate is open", "copies_question"), ("Which gate is open?", "which gate is open? Which gate is open?", "copies_question"), ("Welches Tor ist offen?", "> Welches Tor ist offen?", "copies_question"), ("Quelle porte est ouverte ?", "Quelle porte est ouverte.", "copies_question"), ("どの門が開いていますか？", "どの門が開いていますか?", "copies_question"),
    ("Which gate is open?", "Das Tor an der Nordseite ist offen.", "other_language"), ("Which gate is open?", "La porte du nord est ouverte depuis hier.", "other_language"), ("Welches Tor ist offen?", "La puerta del norte está abierta desde ayer.", "other_language"), ("Quelle porte est ouverte ?", "Северные ворота открыты.", "other_language"), ("¿Qué puerta está abierta?", "The gate on the north side is open.", "other_language"),
    ("Какие ворота открыты?", "北の門が開いている。", "other_language"), ("どの門が開いていますか？", "Das Tor an der Nordseite ist offen.", "other_language"), ("Which gate is open?", "البوابة الشمالية مفتوحة.", "other_language"),
    ("Which gate is open?", "The north gate is open.", ""), ("Which gate is open?", "The north gate is open until nine and then it is closed.", ""), ("Which gate is open?", "north", ""), ("Which gate is open?", "2", ""), ("How many are there?", "14 gates", ""), ("Who has the list?", "Marlow", ""), ("Who has the list?", "gate-3.md", ""), ("Who has the list?", "Marlow keeps 12 of them, and the list was read twice.", ""),
    ("Can the gate be opened?", "The gate refuses to open; it cannot move until Marlow has the key.", ""), ("Can the gate be opened?", "No, it needs the key.", ""), ("Who has the list?", "I can see in the book that Marlow has 5 of them.", ""), ("Who has the list?", "The sign says that we can not answer before noon, so Marlow has it.", ""), ("Who has the list?", "No comment cards are on the list.", ""),
    ("Welches Tor ist offen?", "Das Tor an der Nordseite ist offen.", ""), ("Quelle porte est ouverte ?", "La porte du nord est ouverte.", ""), ("¿Qué puerta está abierta?", "La puerta del norte está abierta.", ""), ("Какие ворота открыты?", "Северные ворота открыты.", ""), ("どの門が開いていますか？", "北の門が開いている。", ""), ("Welches Tor ist offen?", "Marlow", ""), ("Quelle porte est ouverte ?", "3 portes", ""),
    ("Negative test: who has the list?", "DONT-KNOW", ""), ("negative test: Welches Tor ist offen?", "dont-know.", ""), ("Who has the list?", "On the question “Who has the list?”: Marlow has it, and he reads it.", ""),
)

VALIDATION: tuple[tuple[str, str | None, str], ...] = (
    ("Where is the spare key kept?", None, "empty"), ("Where is the spare key kept?", " \t", "empty"), ("Who wrote the rota?", "N/A", "empty"),
    ("Wer hat die Liste geschrieben?", "(none)", "empty"), ("Qui a écrit la liste ?", "...", "empty"), ("¿Dónde está la llave?", "​", "empty"),
    ("Кто написал список?", "TBD", "empty"), ("誰が鍵を持っていますか？", "-", "empty"),
    ("Where is the spare key kept?", "It hangs behind the door of the", "truncated"), ("Where is the spare key kept?", "It hangs behind the door of the stor", "truncated"),
    ("How deep is the well?", "The well is nine yards deep (see the", "truncated"), ("Wie tief ist der Brunnen?", "Der Brunnen ist neun Meter tief und", "truncated"),
    ("Quelle est la profondeur du puits ?", "Le puits a une profondeur de", "truncated"), ("¿Qué profundidad tiene el pozo?", "El pozo tiene una profundidad de …", "truncated"),
    ("Какая глубина у колодца?", "Глубина колодца равна девяти ме", "truncated"), ("井戸の深さはいくつですか？", "井戸の深さは古い図に", "truncated"), ("誰が鍵を持っていますか？", "田中が", "truncated"),
    ("Where is the spare key kept?", "I'm sorry, but I can't answer that question.", "refusal"), ("Where is the spare key kept?", "DONT-KNOW", "refusal"), ("Who wrote the rota?", "dont-know.", "refusal"),
    ("Who wrote the rota?", "As a language model, I am unable to comment on that.", "refusal"), ("Wie tief ist der Brunnen?", "Dazu kann ich leider nichts sagen.", "refusal"),
    ("Quelle est la profondeur du puits ?", "Désolé, je ne peux pas répondre.", "refusal"), ("¿Qué profundidad tiene el pozo?", "Lo siento, no puedo ayudar con eso.", "refusal"),
    ("Какая глубина у колодца?", "Извините, я не могу помочь с этим.", "refusal"), ("井戸の深さはいくつですか？", "申し訳ありませんが、回答できません。", "refusal"),
    ("Where is the spare key kept?", "Where is the spare key kept?", "copies_question"), ("Who wrote the rota?", "> who wrote the rota", "copies_question"),
    ("Wer hat die Liste geschrieben?", "Wer hat die Liste geschrieben? Wer hat die Liste geschrieben?", "copies_question"), ("井戸の深さはいくつですか？", "井戸の深さはいくつですか", "copies_question"),
    ("Qui a écrit la liste ?", "A: Qui a écrit la liste ?", "copies_question"),
    ("Where is the spare key kept?", "La llave está en la puerta del almacén.", "other_language"), ("Wie tief ist der Brunnen?", "The well is nine yards deep.", "other_language"),
    ("Qui a écrit la liste ?", "Die Liste wurde von der alten Köchin geschrieben.", "other_language"), ("Who wrote the rota?", "Список написал старый повар.", "other_language"),
    ("誰が鍵を持っていますか？", "The cook has the key.", "other_language"), ("¿Dónde está la llave?", "La clé est dans la cave depuis hier.", "other_language"),
    ("Where is the spare key kept?", "It hangs behind the door.", ""), ("Where is the spare key kept?", "rota-7.md", ""), ("Who wrote the rota?", "Marlow", ""), ("How deep is the well?", "9", ""),
    ("How deep is the well?", "9 yards", ""), ("How deep is the well?", "nine yards, roughly", ""), ("Wie tief ist der Brunnen?", "9 Meter", ""), ("Wie tief ist der Brunnen?", "Er ist neun Meter tief (laut Plan).", ""),
    ("Who wrote the rota?", "The door refuses to open; it cannot move until the cook helps.", ""), ("Who wrote the rota?", "It cannot be read until noon; I'm sorry to see it fade.", ""), ("How deep is the well?", "The sign says I cannot answer before noon.", ""), ("Who wrote the rota?", "Marlow wrote it. I'm sorry to see it go.", ""),
    ("Who wrote the rota?", "I can see in the book that Marlow wrote it.", ""), ("Who wrote the rota?", "Marlow wrote it. The book calls it «la vieille liste».", ""),
    ("Negative test: who wrote the rota?", "DONT-KNOW", ""), ("Quelle est la profondeur du puits ?", "Le puits a neuf mètres.", ""), ("¿Dónde está la llave?", "La llave está detrás de la puerta.", ""),
    ("Какая глубина у колодца?", "Глубина равна девяти метрам.", ""), ("井戸の深さはいくつですか？", "井戸の深さは九メートルである。", ""), ("誰が鍵を持っていますか？", "Marlow", ""),
    ("Who wrote the rota?", "On the question “Who wrote the rota”: Marlow did.", ""),
)

_MARK = r"[^\p{L}\p{N}]"
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}’'-]*"
_KANA = r"[\p{IsHiragana}\p{IsKatakana}]"
_BLANKS = r"[\s\p{Z}]"
#: Quotations of any length; a pair holds no mark of its own kind.
_QUOTED = r"«[^«»]*+»|“[^“”]*+”|„[^„“”]*+[“”]|「[^「」]*+」|『[^『』]*+』|‹[^‹›]*+›|\"[^\"]*+\"|(?<!\w)['‘][^'‘’]*+['’](?!\w)"
_FILE = r"(?<![\w./-])[\w./-]+\.(?:md|txt|html?|json|ya?ml|csv)\b|https?://\S+"


def _spoken(c: Column, pattern: str) -> Column:
    """Whether one of the alternatives occurs in words joined by blanks, with a blank at both ends."""
    return c.rlike(f" (?:{pattern}) ")


def _replaced(c: Column, where: str, pattern: str, by: str = " ") -> Column:
    """``pattern`` replaced in texts that have ``where``, a pattern that is quickly looked for."""
    return F.when(c.rlike(where), F.regexp_replace(c, pattern, by)).otherwise(c)


def shown(c: Column) -> Column:
    """Text without invisible characters and blanks at the ends; null is empty."""
    c = F.translate(F.coalesce(c, F.lit("")), "\n\t", "  ")
    odd = F.regexp_replace(F.regexp_replace(c, r"[\p{Cf}\p{Cc}\p{Zl}\p{Zp}]+", ""), f"^{_BLANKS}+|(?<!{_BLANKS}){_BLANKS}+$", "")
    return F.when(c.rlike(r"[^\x20-\x7E]"), odd).otherwise(F.trim(c))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))


def _joined(c: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))


def asked(c: Column) -> Column:
    """A question as shown, without the mark of a negative test."""
    return _replaced(shown(c), r"^.{0,3}(?i:negative)", NEGATIVE_TEST, "")


def prepared(pairs: DataFrame) -> DataFrame:
    """``pairs`` with what the labelling functions look at, one step a projection, so that nothing is worked out twice."""
    df = pairs.withColumns({"_neg": F.coalesce(F.col("q"), F.lit("")).rlike(NEGATIVE_TEST), "_q": asked(F.col("q")), "_a": shown(F.col("a"))})
    led = _replaced(F.col("_a"), "[:：]", r"(?iU)^(?:a|q|answer|question|antwort|réponse|respuesta|ответ|答え?)\s*[:：]\s*", "")
    df = df.withColumns({"_bare": F.regexp_replace(F.lower("_a"), f"^{_MARK}+|(?<!{_MARK}){_MARK}+$", ""), "_w": words(F.col("_a")), "_said": words(led), "_asked": words(F.col("_q"))})
    k = F.when(F.size("_asked") > 0, F.floor(F.size("_said") / F.size("_asked")).cast("int")).otherwise(0)
    df = df.withColumns({"_k": k, "_t": _joined(F.col("_w"))})
    same = (F.col("_k") > 0) & (F.col("_said") == F.flatten(F.array_repeat("_asked", F.col("_k"))))
    reported = _spoken(F.col("_t"), REPORTED)
    own = F.when(reported, F.regexp_replace(F.lower("_a"), rf"(?U)\b(?:{REPORTED})\b[^.!?。]*+", " "))
    df = df.withColumns({
        "_void": F.size("_w") == 0, "_named": F.col("_bare").isin(*PLACEHOLDERS), "_same": same, "_n": F.size("_w"), "_kana": F.col("_a").rlike(_KANA), "_letters": F.length(F.array_join("_w", "")),
        "_sentinel": F.when(F.col("_bare").startswith("don"), F.regexp_replace(F.regexp_replace("_bare", "['’]", ""), "[^a-z]+", "-") == SENTINEL).otherwise(False),
        "_own": F.when(reported, _joined(words(own))).otherwise(F.col("_t")),
    })
    c = F.col
    ja = lambda pattern: c("_kana") & c("_a").rlike(pattern)
    return df.withColumns({
        "_else": c("_void") | c("_named") | c("_sentinel") | c("_same"),
        "_unwilling": _spoken(c("_own"), UNWILLING) | ja(UNWILLING_JA), "_acts": _spoken(c("_own"), ACTS) | ja(ACTS_JA), "_self": _spoken(c("_own"), SELF) | c("_kana"),
        "_excuse": _spoken(c("_t"), EXCUSES) | ja(EXCUSES_JA), "_told": c("_a").rlike("[0-9]") | _spoken(c("_t"), TOLD) | c("_void") | c("_named") | c("_same"),
        **_forms(),
    })


def _forms() -> dict[str, Column]:
    """How an answer ends, and what is left open in it."""
    c, last = F.col, F.try_element_at("_w", F.lit(-1))
    more = lambda a, b: F.length(F.translate("_a", a, "")) < F.length(F.translate("_a", b, ""))
    opened = more("(（", ")）") | more("[", "]") | more("「", "」") | more("«", "»") | (more("“", "”") & ~c("_a").contains("„"))
    dots = c("_a").rlike(rf"(?:\.\.|…){_MARK}*+$")
    return {
        "_opened": c("_a").rlike(r"[(（\[「«“]") & opened, "_trails": dots & c("_a").rlike(r"[\p{L}\p{N}]\s*+(?:\.\.\.|…)$"),
        "_ends": ~dots & c("_a").rlike(r"[.!?。！？؟।][\"'”’»」』）)\]*_]*+$"), "_spoken": (c("_n") >= 4) | (c("_kana") & (c("_letters") >= 5)),
        "_dangling": ((c("_n") > 1) & last.isin(*OPEN_WORDS)) | (c("_kana") & c("_bare").rlike("(?:" + "|".join(JA_PARTICLES) + ")$")),
        "_jaccard": F.size(F.array_intersect("_said", "_asked")) / F.greatest(F.size(F.array_union("_said", "_asked")), F.lit(1)), "_ratio": F.size("_said") / F.greatest(F.size("_asked"), F.lit(1)),
    }


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (v.when(F.coalesce(no, F.lit(False)), -1) if no is not None else v).otherwise(0)


def functions(languages) -> dict[str, list[Column]]:
    """The labelling functions of each defect over ``prepared`` pairs; ``languages`` gives those of other_language."""
    c = F.col
    ends, spoken, dangling, jaccard, ratio, open_talk = c("_ends"), c("_spoken"), c("_dangling"), c("_jaccard"), c("_ratio"), ~c("_else")
    return {
        "empty": [
            _vote(c("_void"), c("_n") >= 3),  # marks only
            _vote(c("_named"), ~c("_void") & ~F.arrays_overlap("_w", F.array(*map(F.lit, PLACEHOLDERS)))),  # a placeholder word
            _vote(c("_letters") <= 4, c("_letters") >= 12),  # size
        ],
        "truncated": [
            _vote(~ends & spoken & ~c("_else"), ends),  # as long as a sentence, but without a closing mark
            _vote(F.lit(False), ~spoken & ~dangling),  # too short for a sentence, so it needs no mark
            _vote(dangling),  # a word after which a phrase goes on
            _vote(c("_opened") | c("_trails")),  # an open bracket or dots
            _vote(F.lit(False), c("_else")),  # another kind of answer
        ],
        "refusal": [
            _vote((c("_unwilling") & open_talk) | (c("_sentinel") & ~c("_neg")), ~c("_unwilling") & open_talk),  # cannot, will not, does not know
            _vote(c("_acts") & open_talk, ~c("_acts") & open_talk),  # answer, help, comment
            _vote(c("_self") & open_talk, ~c("_self") & open_talk),  # speaks of itself
            _vote(c("_excuse") & open_talk),  # apology
            _vote(F.lit(False), c("_told")),  # facts and reasons
            _vote(c("_sentinel") & ~c("_neg"), c("_sentinel") & c("_neg")),  # the sentinel
        ],
        "copies_question": [
            _vote(c("_same"), ~c("_same")),  # the same words in order
            _vote(jaccard >= 0.999, jaccard < 0.6),  # the same set of words
            _vote((ratio > 0.9) & (F.abs(ratio - F.round(ratio)) < 0.1), (ratio < 0.5) | (ratio > 3.5)),  # as long, or a multiple
            _vote(c("_a").rlike(r"[?？؟]\W*$")),  # is a question itself
        ],
        "other_language": [*languages, _vote(F.lit(False), c("_else") | (c("_unwilling") & c("_acts")))],
    }


@cache
def _script_of(letter: str) -> str:
    name = unicodedata.name(letter, "").split(" ")[0]
    return {"HIRAGANA": "KANA", "KATAKANA": "KANA", "CJK": "HAN"}.get(name, name)


_WORDS = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}’'-]*")
_CAPITALISED = regex.compile(r"\b\p{Lu}[\p{L}\p{M}’'-]*")
#: Letters from which on a text in Han letters alone is taken for Chinese beside a Japanese one.
HAN_ONLY = 12


def script(s: str) -> tuple[str, int]:
    """The script of most letters of a text and their number; capitalised words, mostly names, count only if there are no others."""
    if s.isascii():
        return "LATIN", sum(map(str.isalpha, s))
    rest = _CAPITALISED.sub("", s)
    n = Counter(_script_of(ch) for ch in (rest if any(map(str.isalpha, rest)) else s) if ch.isalpha())
    if not n:
        return "LATIN", 0
    top = "KANA" if n["KANA"] else max(n, key=lambda k: (n[k], k))
    return top, n[top] + (n["HAN"] if top == "KANA" else 0)


def by_function_words(s: str) -> str | None:
    """The language most of whose function words occur, if it stands out; a script of few languages names itself."""
    kind = script(s)[0]
    if kind not in ("LATIN", "CYRILLIC"):
        return kind
    n = dict.fromkeys(FUNCTION_WORDS, 0)
    for w in _WORDS.findall(s.replace("'", " ").replace("’", " ")):
        for lang in WORD_LANGUAGES.get(w.lower(), ()):
            n[lang] += 1
    (x, a), (y, _) = sorted(((k, lang) for lang, k in n.items()), reverse=True)[:2]
    return a if x > y else None


class Trigrams:
    """Naive Bayes over character trigrams of a text's lower-case words."""

    def __init__(self, labelled: Sequence[tuple[str, str]]) -> None:
        counts: dict[str, Counter] = {}
        for text, lang in labelled:
            counts.setdefault(lang, Counter()).update(self.grams(text))
        names = {g for c in counts.values() for g in c}
        self.langs = sorted(counts)
        sums = {x: sum(counts[x].values()) + 0.5 * len(names) for x in self.langs}
        self.logs = {g: tuple(math.log((counts[x][g] + 0.5) / sums[x]) for x in self.langs) for g in names}
        self.rest = tuple(math.log(0.5 / sums[x]) for x in self.langs)

    @staticmethod
    def grams(text: str) -> list[str]:
        # Words with a capital within a sentence are mostly names, which belong to every language.
        found = [w for i, w in enumerate(_WORDS.findall(text)) if not (w[:1].isupper() and i)]
        return [p[i : i + 3] for w in found if not w[:1].isdigit() for p in [f"_{w.lower()}_"] for i in range(len(p) - 2)]

    LEAST = 8  # trigrams without which there is no opinion

    def guess(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and its lead over the next, per trigram."""
        grams = self.grams(text)
        if len(grams) < self.LEAST or len(self.langs) < 2:
            return None, 0.0
        sums = [sum(x) / len(grams) for x in zip(*(self.logs.get(g, self.rest) for g in grams))]
        score = sorted(zip(sums, self.langs), reverse=True)
        return score[0][1], score[0][0] - score[1][0]


def language_votes(ask: str, content: str, model: Trigrams) -> tuple[int, int, int, int]:
    """By script, by function words, by trigrams, and against for an answer of one word or none."""
    (sq, _), (sa, n) = script(ask), script(content)
    if len(_WORDS.findall(content)) < 2 and sa == "LATIN":
        return 0, 0, 0, -1
    if {sq, sa} == {"HAN", "KANA"}:
        return int(sa == "HAN" and n >= HAN_ONLY or sa == "KANA"), 0, 0, 0
    if sq != sa:
        return int(n > 0), 0, 0, 0
    lq, la = by_function_words(ask), by_function_words(content)
    ga, lead = model.guess(content)
    if lq is None:
        lq, sure = model.guess(ask)
        lq = lq if sure > 0.3 else None
    return 0, 0 if not (la and lq) else 1 if la != lq else -1, 0 if not (ga and lq) or lead <= 0.3 else 1 if ga != lq else -1, 0


def voted(pairs: DataFrame, keys: Sequence[str], model: Trigrams) -> DataFrame:
    """(keys, a code for each defect): the votes of all labelling functions."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def vote(ask: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([language_votes(q, a, model) if isinstance(a, str) else (0, 0, 0, 0) for q, a in zip(ask, content)], dtype=object)

    df = prepared(pairs)
    files = lambda c: _replaced(c, r"\.(?:md|txt|htm|json|ya?ml|csv)|://", _FILE)
    df = df.withColumns({"_content": _replaced(F.col("_a"), "[«“„「『‹\"'‘]", f"(?U){_QUOTED}"), "_ask": files(F.col("_q"))})
    df = df.withColumn("_content", files(F.col("_content")))
    wordy = ~F.col("_else") & F.col("_content").rlike(r"\p{Ll}|\p{Lo}")
    df = df.withColumn("_lang", vote(F.col("_ask"), F.when(wordy, F.col("_content"))))
    shared = F.size(F.array_intersect("_w", "_asked"))
    languages = [F.element_at("_lang", i) for i in (1, 2, 3, 4)] + [_vote((shared == 0) & (F.col("_n") >= 4), shared >= 2)]
    codes = {d: sum(((v + 1) * 3**i for i, v in enumerate(f)), F.lit(0)).cast("int") for d, f in functions(languages).items()}
    return df.select(*keys, *[code.alias(d) for d, code in codes.items()])


def decoded(code: int, k: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 - 1 for i in range(k))


#: Number of labelling functions of each defect.
SIZES = dict(zip(DEFECTS, (3, 5, 6, 4, 6)))
Counts = dict[tuple[int, ...], float]


class LabelModel:
    """One hidden label, conditionally independent votes for or against it; fitted by EM on pattern counts.

    ``yes`` and ``no`` are counts of patterns on labelled pairs with and without the defect. They give the
    first estimate, and stay in every later one as pseudo-pairs, HELD of them for each pair of the data.
    A vote weighs what the rates of that vote among pairs with and without the defect say; an abstention
    weighs nothing, whatever its rates.
    """

    HELD, SHARE = 0.5, 0.03

    def __init__(self, yes: Counts, no: Counts) -> None:
        self.k = len(next(iter([*yes, *no])))
        self.share = self.SHARE
        # By function and label: the rates of votes for (0) and against (1).
        self.start = [[self._rates(side, i) for side in (yes, no)] for i in range(self.k)]
        self.p = self.start

    @staticmethod
    def _rates(side: Counts, i: int) -> tuple[float, float]:
        n = sum(side.values())
        return tuple((sum(m for v, m in side.items() if v[i] == x) + 0.5) / (n + 1.5) for x in (1, -1))

    def posterior(self, v: tuple[int, ...]) -> float:
        odds = math.log(self.share / (1 - self.share))
        for (a, b), x in zip(self.p, v):
            if x:
                odds += math.log(a[x < 0] / b[x < 0])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

    def fit(self, counts: Counts, rounds: int = 100) -> LabelModel:
        total = sum(counts.values())
        held = max(30.0, self.HELD * total)
        # Pseudo-pairs are split between the labels as pairs are at the start.
        kept = (held * self.SHARE, held * (1 - self.SHARE))
        for _ in range(rounds if total else 0):
            r = {v: self.posterior(v) for v in counts}
            yes = sum(r[v] * n for v, n in counts.items())
            sums = (yes + kept[0], total - yes + kept[1])
            p = []
            for i in range(self.k):
                p.append([])
                for side in (0, 1):
                    seen = [sum(n * (r[v] if side == 0 else 1 - r[v]) for v, n in counts.items() if v[i] == x) for x in (1, -1)]
                    p[i].append(tuple((s + kept[side] * t) / sums[side] for s, t in zip(seen, self.start[i][side])))
            share = sums[0] / (total + held)
            done = abs(share - self.share) < 1e-9
            self.p, self.share = p, share
            if done:
                break
        return self


def _odds(p: float) -> float:
    return math.log(max(p, 1e-15) / max(1 - p, 1e-15))


def cutoff(scored: list[tuple[float, bool]]) -> float:
    """The cutoff with the best F1 on labelled pairs: a half if it is one, else the middle (in log odds) of the widest such gap between posteriors."""
    values = sorted({_odds(s) for s, _ in scored})
    gaps = [(b - a, (a + b) / 2) for a, b in itertools.pairwise(values)] or [(0.0, 0.0)]
    positives = sum(t for _, t in scored)

    def f1(c: float) -> float:
        hit, found = sum(t for s, t in scored if _odds(s) > c), sum(_odds(s) > c for s, _ in scored)
        return 2 * hit / (positives + found) if positives + found else 0.0

    best = max(f1(c) for _, c in [*gaps, (0.0, 0.0)])
    if f1(0.0) >= best - 1e-12:
        return 0.5
    return 1 / (1 + math.exp(-max((w, c) for w, c in gaps if f1(c) >= best - 1e-12)[1]))


def language_model(pairs: DataFrame, most: int = SAMPLE) -> Trigrams:
    """Trigrams of a bounded sample of distinct questions, taken by hash, and of an answer to each, labelled by function words."""
    n = pairs.count()
    every = n // most + 1
    rows = pairs.where(F.col("q").isNotNull() & (F.pmod(F.xxhash64("q"), F.lit(every)) == 0)).groupBy("q").agg(F.min("a").alias("a"))
    rows = rows.orderBy(F.xxhash64("q"), "q").limit(2 * most).select(asked(F.col("q")).alias("q"), F.regexp_replace(shown(F.col("a")), f"(?U){_QUOTED}", " ").alias("a")).collect()
    texts = [(r.q, by_function_words(r.q), r.a) for r in rows]
    labelled = [(q, lang) for q, lang, _ in texts]
    # Answers in which the function words of their question's language prevail, too.
    labelled += [(a, lang) for _, lang, a in texts if a and lang and by_function_words(a) == lang]
    return Trigrams([(t, lang) for t, lang in labelled + [(q, by_function_words(q)) for q, _, _ in LABELLED + VALIDATION] if lang])


def label_models(counts: dict[str, Counts], labelled: list[tuple[str, dict[str, int]]], checked: list[tuple[str, dict[str, int]]]) -> dict[str, tuple[LabelModel, float]]:
    """For each defect its fitted model and cutoff; labelled pairs are (label, code by defect)."""
    out = {}
    for d in DEFECTS:
        sides: tuple[Counts, Counts] = ({}, {})
        for label, codes in labelled:
            side, v = sides[label != d], decoded(codes[d], SIZES[d])
            side[v] = side.get(v, 0) + 1
        model = LabelModel(*sides).fit(counts[d])
        out[d] = (model, cutoff([(model.posterior(decoded(codes[d], SIZES[d])), label == d) for label, codes in checked]))
    return out


def _votes_on(spark, pairs: Sequence[tuple], model: Trigrams) -> list[tuple[str, dict[str, int]]]:
    """The votes on labelled pairs (some dozens, written in this module)."""
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(pairs)], "_i int, q string, a string").coalesce(1)
    return [(pairs[r["_i"]][2], {d: r[d] for d in DEFECTS}) for r in sorted(voted(df, ["_i"], model).collect(), key=lambda r: r["_i"])]


def defects(pairs: DataFrame, keys: Sequence[str] = ("path", "id")) -> DataFrame:
    """(keys, defect, posterior): every defect of a pair whose posterior exceeds its validated cutoff."""
    pairs = pairs.select(*keys, "q", "a")
    spark = pairs.sparkSession
    model = language_model(pairs)
    votes = written(voted(pairs.distinct(), keys, model), "votes")
    stacked = votes.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("code")) for d in DEFECTS])).alias("x")).select("x.*")
    counts: dict[str, Counts] = {d: {} for d in DEFECTS}
    for r in stacked.groupBy("defect", "code").count().collect():  # at most 3**6 patterns a defect
        counts[r["defect"]][decoded(r["code"], SIZES[r["defect"]])] = r["count"]
    marks, known = [], _votes_on(spark, LABELLED + VALIDATION, model)
    for d, (fitted, cut) in label_models(counts, known[: len(LABELLED)], known[len(LABELLED) :]).items():
        over = {sum((x + 1) * 3**i for i, x in enumerate(v)): p for v in counts[d] if (p := fitted.posterior(v)) > cut}
        post = F.create_map(*[F.lit(x) for kv in over.items() for x in kv]) if over else F.create_map(F.lit(-1), F.lit(0.0))
        marks.append(F.struct(F.lit(d).alias("defect"), F.try_element_at(post, F.col(d)).alias("posterior")))
    return votes.select(*keys, F.explode(F.array(*marks)).alias("x")).select(*keys, "x.defect", "x.posterior").where("posterior is not null")
