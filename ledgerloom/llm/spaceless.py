"""Word lattices of the scripts without spaces: what stands before a gap, what opens after it.

A run of a script is a lattice of dictionary words, each with a cost; the cheapest path segments it, where
characters no word covers cost more than any word. The dictionary is the closed classes below (particles,
endings, words that open a sentence, and words that only look like one of them), and the whole words of a
public vocabulary file with costs that follow from their rank in it (Zipf's law). Without that file the closed
classes alone are the dictionary.

A gap's score is that of its mark plus that of the word before it (a final particle or ending, or one by
which a sentence runs on) plus that of the word after it (one that opens a sentence, one by which the same
sentence runs on, or one that cannot open any).
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterable
from functools import lru_cache

import regex

#: A public byte-level vocabulary of many languages, one token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Japanese: endings and particles that close a sentence; particles and forms by which it runs on; words that
# open one; particles that cannot open one before a word of content; quoting particles after a quotation.
JA_FINAL = "た だ る です ます でした ました ません ましょう でしょう だろう である であった ない なかった か ね よ ぞ わ な さ かな よね だね ですか ますか ください のだ のです んです".split()
JA_RUNS_ON = (
    "て で って れて して せて けて めて えて んで いて きて ては では には とは ても でも が は を に の も と や へ し ば なら たら つつ ながら たり から まで より ので のに けど けれど けれども だけ "
    "やがて そして それから ついに とうとう 結局".split()
)
JA_OPENS = "これ この それ その あれ あの ここ そこ どこ だれ 誰 なぜ いつ 何 しかし だが また だから ただし ところが さて まず 次 もし なお つまり 私 彼 彼女 今日 昨日 はじめ でも では".split()
JA_NO_OPENING = "は を が の に も へ".split()
JA_QUOTES_ON = "と って とは とも という といった といって などと など との とか".split()
JA_OTHER = "はい はず はじめて はなし はやく はっきり はは がん がんばる のち のみ のど にわ にわか にほん もう もし もの もっと もちろん もともと とても とき ところ とにかく へや へえ こと ため よう".split()
# Chinese, simplified and traditional.
ZH_FINAL = "了 吗 嗎 呢 吧 啊 呀 嘛 啦 哦 的 过 過 着 著".split()
ZH_RUNS_ON = "最后 最後 然后 然後 就 才 又 也 却 卻 于是 於是 终于 終於 接着 接著 随后 隨後 还 還 便".split()
ZH_OPENS = "这 這 那 我 你 他 她 它 我们 我們 他们 他們 谁 誰 没人 沒人 因为 因為 如果 但 但是 所以 为什么 為什麼 怎么 怎麼 今天 第 本 虽然 雖然 不过 不過 可是 有人".split()
ZH_NO_OPENING = "的 吗 嗎 呢 吧 嘛 们 們".split()
ZH_SPEECH = "问 問 喊 说 說 道 叫 答 回答 写 寫 问道 說道 说道 喊道 叫道 答道 告诉 告訴".split()
ZH_OTHER = "的确 的確 的士 目的 知道 道路 道理 道歉 街道 味道 频道 頻道 叫做 说明 說明 小说 小說 传说 傳說 写作 了解 着急 过去 過去 就是 还是 還是 也许 也許 便宜 才能 又是".split()
# Thai.
TH_FINAL = "แล้ว ครับ ค่ะ คะ นะ ไหม หรือ เลย กัน นั้น นี้ ด้วย อยู่ ไป มา".split()
TH_OPENS = "แต่ และ เพราะ ถ้า เมื่อ ไม่ ใคร ทำไม อะไร เขา เธอ ฉัน ผม เรา มัน นี่ นั่น อย่า วันนี้ ดังนั้น อย่างไรก็ตาม หลังจาก".split()
TH_NO_OPENING = "ๆ ฯ ครับ ค่ะ คะ นะ".split()
TH_OTHER = "คะแนน ครับผม นะโม นคร นัก ไหมพรม ที่ ใน ของ เป็น จะ ได้ ให้ มี ว่า การ ความ คน วัน ปี บ้าน น้ำ ทำ เห็น เปิด ปิด ไว้ ยัง ถูก หน้า เก่า ใหม่ หลัง ก่อน ขึ้น ลง ออก เข้า จน จึง ทุก นี้ต่าง ต่าง เด็ก ดี มาก".split()

FINAL = {"ja": JA_FINAL, "zh": ZH_FINAL, "th": TH_FINAL}
RUNS_ON = {"ja": JA_RUNS_ON, "zh": ZH_RUNS_ON, "th": []}
OPENS = {"ja": JA_OPENS, "zh": ZH_OPENS, "th": TH_OPENS}
NO_OPENING = {"ja": JA_NO_OPENING, "zh": ZH_NO_OPENING, "th": TH_NO_OPENING}
REST = {"ja": JA_QUOTES_ON + JA_OTHER, "zh": ZH_SPEECH + ZH_OTHER, "th": TH_OTHER}
#: By script, with what letters an unopening word can begin: other gaps are ends whatever the lattice says.
UNOPENED = {k: frozenset(w[0] for w in v) for k, v in NO_OPENING.items()}

#: What the mark of a gap speaks for: a full mark, the blank between two Thai characters, an ellipsis.
FULL, BLANK, ELLIPSIS = 3.0, 2.0, 0.5

_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}]")
_HIRAGANA = regex.compile(r"\p{Hiragana}")
_JA_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]*[\p{Hiragana}\p{Katakana}][\p{Han}\p{Hiragana}\p{Katakana}ー]*")
_ZH_WORD = regex.compile(r"\p{Han}{2,}")


class WordLattice:
    """Cheapest segmentation of runs into the words of a dictionary."""

    def __init__(self, words: dict[str, float]) -> None:
        from tokenizers import Tokenizer, models

        self._lattice = Tokenizer(models.Unigram([("\0", 0.0), *((w, -c) for w, c in sorted(words.items()))], 0))
        self.segment = lru_cache(maxsize=65_536)(self._segment)

    def _segment(self, run: str) -> tuple[str, ...]:
        return tuple(run[a:b] for a, b in self._lattice.encode(run, add_special_tokens=False).offsets)


def dictionary(script: str, vocabulary: Iterable[tuple[str, int]] = ()) -> dict[str, float]:
    """Costs of a script's words: a vocabulary's by rank, the closed classes as cheap as its commonest."""
    costs = {w: math.log(rank + 2) for w, rank in vocabulary}
    for w in FINAL[script] + RUNS_ON[script] + OPENS[script] + NO_OPENING[script] + REST[script]:
        costs[w] = 6.0 - 0.5 * min(4, len(w))
    return costs


def vocabulary_words(path: str = VOCABULARY) -> dict[str, list[tuple[str, int]]]:
    """Words of two or more letters of a vocabulary file, by script, with ranks; nothing if there is no such file.

    Thai is left out: its tokens are mostly shorter than a syllable.
    """
    found: dict[str, list[tuple[str, int]]] = {"ja": [], "zh": []}
    if not os.path.exists(path):
        return found
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            try:
                word = base64.b64decode(token).decode().strip()
            except UnicodeDecodeError:
                continue
            if len(word) > 1:
                for script, pattern in (("ja", _JA_WORD), ("zh", _ZH_WORD)):
                    if pattern.fullmatch(word):
                        found[script].append((word, int(rank)))
    found["ja"] += found["zh"]  # words in Han letters occur in both
    return found


class Lattices:
    """The word lattices of all spaceless scripts, and the scores of gaps by them."""

    def __init__(self, words: dict[str, list[tuple[str, int]]] | None = None) -> None:
        words = words or {}
        self.of = {k: WordLattice(dictionary(k, words.get(k, ()))) for k in FINAL}

    @staticmethod
    def script(before: str, after: str) -> str:
        return "ja" if _KANA.search(before) or _KANA.search(after) else "zh"

    def final(self, script: str, before: str) -> float:
        """What the last word of the run before a gap speaks for."""
        words = self.of[script].segment(before) if before else ()
        return 0.0 if not words else 1.0 if words[-1] in FINAL[script] else -1.0 if words[-1] in RUNS_ON[script] else 0.0

    def opening(self, script: str, after: str, full: bool) -> float:
        """What the first word of the run after a gap speaks for; after a full mark a new sentence may begin with any connective."""
        words = self.of[script].segment(after) if after else ()
        if not words:
            return 0.0
        # A particle is one only before a word of content, else it is the head of a word the dictionary lacks.
        if words[0] in NO_OPENING[script] and (script != "ja" or (len(words) > 1 and not _HIRAGANA.match(words[1]))):
            return -4.5
        if words[0] in OPENS[script]:
            return 1.0
        return -2.5 if not full and words[0] in RUNS_ON[script] else 0.0

    def gap(self, before: str, after: str, mark: float, script: str | None = None) -> float:
        """How far a gap between two runs of a spaceless script is a sentence end (positive) or not."""
        script = script or self.script(before, after)
        full = mark != ELLIPSIS
        if full and after[:1] not in UNOPENED[script]:
            return mark  # neither word can turn this
        return mark + self.final(script, before) + self.opening(script, after, full)

    def quotes_on(self, after: str) -> bool:
        """Whether a Japanese run goes on quoting: と, って, という."""
        return self.of["ja"].segment(after)[:1] != () and self.of["ja"].segment(after)[0] in JA_QUOTES_ON

    def speaks(self, run: str) -> bool:
        """Whether a Chinese run has a word of saying."""
        return any(w in ZH_SPEECH for w in self.of["zh"].segment(run))


@lru_cache(maxsize=1)
def plain_lattices() -> Lattices:
    """Lattices over the closed classes only."""
    return Lattices()
