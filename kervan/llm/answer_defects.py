"""Problem 4: answers that do not answer their question.

Method, in the order in which a row's only defect is looked for:
empty     nothing but blanks, invisible characters or a placeholder;
refusal   an automaton of refusing phrases finds one outside quotations, and little else is said;
copy      the answer's words are walked through a suffix automaton of the question's words: the share of the answer that
          lies in copied stretches, and that of the question they cover, are high;
language  votes of stopwords and letters outside quotations give the answer another language than the question;
truncated a stack of delimiters stays open at the end, a sign of breaking off stands there, or the last word is one with
          which sentences of this collection do not end (counted over all answers).
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kervan.llm import encoding
from kervan.llm.common_form import form_array
from kervan.llm.splitting import is_space
from kervan.llm.util import cut_lineage, first_of_key
from kervan.llm.words import each

# What stands where an answer is missing, letters folded, marks at the ends taken off.
PLACEHOLDERS = {"", "n a", "na", "nan", "null", "none", "nil", "tbd", "todo", "yok", "boş", "bos", "empty", "cevap", "yanıt", "yanit", "answer", "p p", "br", "xxx", "belirtilmemiş", "bilgi yok", "cevap yok", "yanıt yok"}
# Phrases of answers that decline or do not know, letters folded.
REFUSALS = [
    "bilmiyorum", "cevap veremem", "yanıt veremem", "yanıt veremiyorum", "cevap veremiyorum", "cevap vermem mümkün değil", "yanıt vermem mümkün değil", "tavsiye veremem", "tavsiyesi veremem",
    "yardımcı olamıyorum", "yardımcı olamam", "yardım edemem", "cevap üretemiyorum", "yanıt üretemiyorum", "cevap üretemem", "değerlendirme yapamam", "değerlendirme yapamıyorum", "yerine getiremeyeceğim", "yerine getiremem",
    "görüş bildiremem", "görüş bildiremiyorum", "bilgi paylaşmam uygun olmaz", "paylaşmam uygun olmaz", "bilgi veremem", "bu bilgi yer almıyor", "bilgi bulunmuyor", "cevap bulunamadı", "yanıt bulunamadı", "cevaplayamam", "cevaplayamıyorum", "yanıtlayamam", "yanıtlayamıyorum",
    "yeterli bilgi bulunmamaktadır", "fikrim yok", "bilgim yok", "bilgiye sahip değilim", "uzmanına sorunuz",
    "ı cannot give", "ı cannot provide", "ı cannot answer", "ı cannot help", "ı can't help", "ı can t help", "ı can't answer", "ı can't provide", "ı'm sorry", "ı am sorry", "ı'm unable", "ı am unable", "ı am not able", "ı don't know", "ı do not know", "as a language model", "as an ai", "unable to assist", "cannot assist",
    "ich kann diese frage nicht", "ich kann nicht", "kann ich nicht beantworten", "ich weiß es nicht", "weiß ich nicht", "kann ihnen nicht helfen", "kann keine", "tut mir leid", "je ne peux pas", "je ne sais pas", "je suis désolé", "no puedo", "no lo sé", "lo siento", "non posso", "non lo so", "mi dispiace",
    "لا أعرف", "لا أستطيع", "عذرا", "لا يمكنني", "آسف", "не могу", "не знаю", "извините",
]
# Frequent short words by language, letters folded.
STOPWORDS = {
    "tr": "ve bir bu ile için veya olarak ancak da de göre sonra önce birlikte kadar karşı hakkında hâlinde olan ait yer varsa uyarınca gün ay yıl lira madde üzerine dayanan arasında tarafından itibaren kendiliğinden değil ki ne hangi mi mı mu mü nasıl kim gibi daha her o şu ise sadece evet hayır yüzde inci aykırı nedeniyle yerine altında üzerinden ek ilk son".split(),
    "en": "the of and to in is be by with that on shall may not no for it as are was from which this an or at has have been after before under into than other only if where must both unless file days months years".split(),
    "de": "der die das und ist nicht mit von den dem des ein eine einer zu im auf für sich als auch nach bei nur wenn aus wird wurde werden durch vor ja aber hat hat über unter oder innerhalb".split(),
    "fr": "le la les des du de et est un une en que qui dans par pour sur pas au aux ne ce se plus avec sont non car sauf si depuis lorsque".split(),
    "es": "el la los las de y en que un una por con no se del al es para su lo como más sí pero fue ha salvo si dentro desde siempre debe".split(),
    "it": "il lo la gli le di e che un una per con non si del della è in sono nel alla dei entro".split(),
    "pt": "o a os as de e que um uma para com não se do da em no na por mais dos como foi".split(),
    "nl": "de het een en van is niet dat op te in voor met zijn die aan door bij binnen".split(),
}
_VOTES = {w: [lang for lang, ws in STOPWORDS.items() if w in ws] for ws in STOPWORDS.values() for w in ws}
_FOLDED = str.maketrans("ışğçöüâîû", "isgcouaiu")
_TR_FOLDED = {w.translate(_FOLDED) for w in STOPWORDS["tr"] if len(w) > 2}
_SCRIPTS = [("ar", re.compile(r"[؀-ۿ]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("zh", re.compile(r"[一-鿿぀-ヿ]"))]
_FOREIGN_SCRIPT = re.compile(r"[Ͱ-ӿ؀-ۿ぀-鿿]")
_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"")
_TAIL = re.compile(r"(?:\s*(?:\[\s*kaynak\s+\d+\s*\]|\(\s*bkz[^()]*\)|\[\d+\]))+\s*$", re.I)
#: Shares of words that make a copy: of the answer within copied stretches of MIN_RUN words, and of the question covered.
COPIED, COVERED, MIN_RUN = 0.8, 0.7, 3
#: An answer of up to so many words is a refusal by any such phrase; a longer one if the sentences that have one make this share of its words.
REFUSAL_WORDS, REFUSING = 30, 0.5
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Answers of up to this many words may do without a verb.
PHRASE_WORDS = 5
MARK_CODES = np.array([ord(c) for c in ".!?"], dtype=np.uint32)
#: Share of a word's occurrences that end a sentence from which it counts as an ending.
ENDING = 0.1


def fold(s: str) -> str:
    return s.replace("I", "ı").replace("İ", "i").lower()


@functools.cache
def refusal_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in REFUSALS:
        a.add_word(f" {p.replace(chr(39), ' ')} ", p)
    a.make_automaton()
    return a


class SuffixAutomaton:
    """All stretches of a list of words, in states of size at most twice its length."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        link, length, self.end = [-1], [0], [0]
        last = 0
        for at, w in enumerate(words, 1):
            cur = len(length)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            self.end.append(at)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][w]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(length)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    self.end.append(self.end[q])
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.link, self.length = link, length

    def walk(self, words: list[str], least: int) -> tuple[int, set[int]]:
        """(words within matched stretches of at least `least` words, places of the automaton's words that these cover)."""
        state = run = copied = 0
        reached = 0  # words up to here are counted
        covered: set[int] = set()
        for i, w in enumerate(words, 1):
            while state and w not in self.next[state]:
                state = self.link[state]
                run = self.length[state]
            if w in self.next[state]:
                state, run = self.next[state][w], run + 1
            else:
                state = run = 0
            if run >= least:
                copied += min(run, i - reached)
                reached = i
                covered.update(range(self.end[state] - run, self.end[state]))
        return copied, covered


def language(text: str, words: list[str]) -> str | None:
    """The language with the most votes, or None if there are too few. text is folded."""
    if _FOREIGN_SCRIPT.search(text):
        letters = sum(ch.isalpha() for ch in text)
        for lang, pattern in _SCRIPTS:
            if len(pattern.findall(text)) > 0.5 * letters:
                return lang
    votes = {"tr": 0.5 * (text.count("ı") + text.count("ğ") + text.count("ş")), "de": text.count("ß") + text.count("ä")}
    if votes["tr"] > 0.02 * len(text):  # more than stopwords of another language could outvote
        return "tr" if votes["tr"] >= 2 else None
    for w in words:
        for lang in _VOTES.get(w, ()):
            votes[lang] = votes.get(lang, 0) + 1
        if w in _TR_FOLDED and w not in _VOTES:
            votes["tr"] += 1
    (first, most), (_, second) = sorted(votes.items(), key=lambda x: -x[1])[:2]
    return first if most >= 2 and second * 1.3 < most else None


def open_delimiter(s: str) -> bool:
    """A bracket or quotation mark is still open at the end."""
    pairs, stack = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}, []
    for ch in s:
        if ch in "([{“«":
            stack.append(ch)
        elif ch in pairs and stack and stack[-1] == pairs[ch]:
            stack.pop()
    return bool(stack)


def repaired(s: str) -> str:
    """s with wrongly decoded characters restored."""
    if s.isascii() or not any(ch not in encoding.CLEAN and ord(ch) > 127 for ch in s):
        return s
    return encoding.restored(s, encoding.label(s))


def parallel(s: str) -> bool:
    """Short measures side by side ("3 yıl; … varsa 5 yıl"), which need no verb."""
    parts = [_WORD.findall(x) for x in s.split(";")]
    return len(parts) > 1 and all(len(p) >= 2 and p[-2].isdigit() and p[-1] == parts[0][-1] for p in parts) and parts[0][0].isdigit() and len(parts[0]) == 2


def refuses(words: list[str]) -> bool:
    return next(refusal_automaton().iter(f" {' '.join(words)} "), None) is not None


def defect(question: str | None, answer: str | None) -> tuple[str | None, str | None]:
    """(defect, text): the answer's text is given where only the endings of the collection tell whether it breaks off."""
    if answer is None:
        return "empty", None
    answer = repaired(answer)
    folded = fold(answer)
    if len(answer) < 60 and " ".join(_WORD.findall(re.sub(r"<[^<>]*>", " ", folded))) in PLACEHOLDERS or not folded.strip():
        return "empty", None
    question = question or ""
    plain = _QUOTED.sub(" ", folded) if any(c in folded for c in "“«„\"") else folded
    a = _WORD.findall(folded)
    rest = a if plain is folded else _WORD.findall(plain)
    if refuses(rest) and (len(rest) <= REFUSAL_WORDS or sum(len(w) for w in map(_WORD.findall, _SENTENCE.split(plain)) if refuses(w)) >= REFUSING * len(rest)):
        return "refusal", None
    asking = fold(question)
    q = _WORD.findall(asking.translate(_FOLDED))  # bare letters, so that wrong letter case and typing do not hide a copy
    asked = set(q)
    bare = _WORD.findall(folded.translate(_FOLDED))
    if len(q) >= MIN_RUN and len(bare) >= MIN_RUN and sum([w in asked for w in bare]) >= COPIED * len(bare):
        copied, covered = SuffixAutomaton(q).walk(bare, MIN_RUN)
        if copied >= COPIED * len(bare) and len(covered) >= COVERED * len(q):
            return "copy", None
    mine = language(plain, rest) if len(rest) >= 4 else None
    if mine:
        other = language(asking, _WORD.findall(asking))
        if other is None and any(c in "ığş" for c in asking):
            other = "tr"
        if other and mine != other:
            return "language", None
    body = _TAIL.sub("", answer).rstrip(" \t\r\n\xa0​")
    if not body or body[-1] in ".!?。؟”»\"'" or len(a) <= PHRASE_WORDS and body[-1] not in "…-(,;":
        return None, None
    if body[-1] in "…-(,;[{“«–—/" or open_delimiter(body):
        return "truncated", None
    if parallel(fold(body)) or not body[-1].isalnum() or mine in ("ar", "ru", "el", "zh"):
        return None, None
    return None, body


def defects(df: DataFrame, k_id: str = "query_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(query_id, defect) of every record with a defective answer, with its only defect: empty, truncated, refusal, copy or language.

    A null answer is empty; a null question has no language and cannot be copied. Texts are taken whole; rows repeated
    under an id count once; null ids are left out; other columns do not matter; an empty table gives no rows.
    """

    def apply(batches):
        for b in batches:
            ids = b.column(0)
            qs, ans = (form_array(b.column(i)) for i in (1, 2))
            got = [defect(q, a) for q, a in zip(qs.to_pylist(), ans.to_pylist())]
            n_end: Counter[int] = Counter()
            n_all: Counter[int] = Counter()
            for _, w in each(ans, bare=True):  # words that end sentences, and all words, by hash
                codes = np.append(w.codes, [10, 10])
                ends = np.isin(codes[w.end], MARK_CODES) & is_space(codes[w.end + 1]) | np.isin(w.end + 1, w.offset) & np.isin(codes[w.end], MARK_CODES)
                for total, h in ((n_all, w.hash), (n_end, w.hash[ends])):
                    values, count = np.unique(h.view(np.int64), return_counts=True)
                    total.update(dict(zip(values.tolist(), count.tolist())))
            keep = [i for i, (d, t) in enumerate(got) if d or t]
            last: dict[int, int] = {}
            unsure = [i for i in keep if not got[i][0]]
            for lo, w in each(pa.array([got[i][1] for i in unsure], pa.string()), bare=True):
                for d in np.flatnonzero(np.diff(w.first)):
                    last[unsure[lo + d]] = int(w.hash[w.first[d + 1] - 1].view(np.int64))
            words = list(n_all)
            n, m = len(keep), len(words)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([ids.take(pa.array(keep, pa.int64())), pa.nulls(m, pa.string())]), pa.array([got[i][0] for i in keep] + [None] * m, pa.string()), pa.array([last.get(i) for i in keep] + words, pa.int64()),
                 pa.array([None] * n + [n_end[w] for w in words], pa.int64()), pa.array([None] * n + [n_all[w] for w in words], pa.int64())],
                names=["query_id", "defect", "word", "n_end", "n_all"],
            )

    rows = first_of_key(df.where(F.col(f"`{k_id}`").isNotNull()).select(F.col(f"`{k_id}`").cast("string").alias("i"), F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a")), "i")
    seen = cut_lineage(rows.mapInArrow(apply, "query_id string, defect string, word bigint, n_end bigint, n_all bigint"))
    stats = seen.where("query_id IS NULL").groupBy("word").agg(F.sum("n_end").alias("n_end"), F.sum("n_all").alias("n_all"))
    sure = seen.where("query_id IS NOT NULL AND defect IS NOT NULL").select("query_id", "defect")
    unsure = seen.where("query_id IS NOT NULL AND defect IS NULL").select("query_id", "word")
    cut = unsure.join(stats.where(F.col("n_end") >= ENDING * F.col("n_all")), "word", "left_anti").select("query_id", F.lit("truncated").alias("defect"))
    return sure.unionAll(cut)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(spark.read.parquet(f"{sf_dir}/qa_examples.parquet"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = spark.read.parquet(f"{sf_dir}/qa_examples.parquet")
    about = qa.groupBy("query_id").agg(F.min("source").alias("source"))
    return p4_found(spark, sf_dir).join(about, "query_id").groupBy("source", "defect").agg(F.count("*").alias("n"))
