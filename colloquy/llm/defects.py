"""Problem 4: broken prompt and response pairs.

Method: a multi-label linear classifier on hashed n-grams and pair features, trained on synthetic
defects. From a bounded sample of answers (about ``FIT_ROWS`` pairs, chosen by hash) broken ones are made:
cut off, copied from the question, swapped with an answer in another language, refused, emptied; and
hard sound ones: the closing mark lost, a polite ending added, the question quoted and then answered,
an apology followed by help. After a first fit, sampled answers that the model itself finds broken
are taken out of the sound examples and the model is fitted again. The thresholds are calibrated on
held-out synthetic pairs.

The fitted weights are a fixed-size array and travel to the workers; every answer of all rows is
scored on its whole text.

Defined results: a null answer is empty; a null or blank question never makes a copy or another
language; rows delivered twice give one result; null ids are left out; an answer gets at most one
defect; with an empty table there is nothing to fit and no defect; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LABELS = ("empty", "copy", "other_language", "refusal", "truncated")
FIT_ROWS = 4000
DIM = 1 << 16
SOUND_WEIGHT = 4.0  # sound answers are far more frequent than in the synthetic set

# Fillers for "no value".
FILLERS = set("无 空 暂无 没有 无内容 略 同上 待补充 未知 null none nil nan na n/a undefined empty nothing placeholder tbd todo blank void keine ninguno aucun なし".split())
# Function words that tell Latin-script languages apart.
FUNCTION_WORDS = {
    "en": set("the is are was your you we our for with and please to of in will can this that have has not it my on at what how".split()),
    "de": set("der die das ist und sie wir ihre ihr für mit nicht auf den dem ein eine zu bei wird haben können uns von im nach bis".split()),
    "fr": set("le la les est vous votre nous pour avec et des du une un dans sur pas été sera avez à de ce sous".split()),
    "es": set("el la los las es usted su para con y del una un en no por se ha está puede que al lo".split()),
}
POLITE = {
    "zh": ["祝您生活愉快", "感谢您的支持~", "谢谢您的理解😊", "有问题随时找我哦", "请您稍等片刻哈~", "感谢理解", "祝您愉快", "麻烦您了"],
    "en": ["Have a nice day", "Thanks for your patience", "Kind regards", "We are happy to help", "Take care :)"],
    "ja": ["よろしくお願いいたします", "ご確認ください"],
    "de": ["Vielen Dank", "Mit freundlichen Grüßen"],
    "fr": ["Merci de votre patience", "Bonne journée"],
    "es": ["Gracias por su paciencia", "Que tenga un buen día"],
}
END = "。！？!?.~～…"
_MARKUP = re.compile(r"<[^<>]{0,60}>|&[a-z]+;|\[[^\[\]]{1,6}\]")
_BRACKETED = re.compile(r"\W*(?:\[[^\[\]]*\]|\{[^{}]*\}|【[^【】]*】|<[^<>]*>)\W*")
_CODE = re.compile(r"(?<![A-Za-z\-])[A-Za-z\-]*\d[A-Za-z0-9\-.]*")
_SCRIPTS = (re.compile("[぀-ヿ]+"), re.compile("[㐀-鿿]+"), re.compile("[A-Za-zÀ-ɏ]+"))
_SENTENCE = re.compile(r"[^。！？!?\n]+?(?:[。！？!?]+|\.(?=\s|$)|\n|$)")


@lru_cache(256)
def core(text: str | None) -> str:
    """Letters and digits left after markup."""
    return re.sub(r"[\W_]+", "", _MARKUP.sub(" ", unicodedata.normalize("NFKC", text or ""))).lower()


@lru_cache(256)
def language(text: str | None) -> str:
    """zh, ja, en, de, fr, es, la (some Latin-script text) or '' if it cannot be told; codes with digits do not count."""
    t = _CODE.sub(" ", unicodedata.normalize("NFKC", text or ""))
    kana, han, latin = (len(t) - len(x.sub("", t)) for x in _SCRIPTS)
    if kana >= 2 and kana * 8 >= han:
        return "ja"
    if han >= 2 and han * 4 >= latin:
        return "zh"
    words = re.findall(r"[a-zà-ɏ']+", t.lower())
    hits = {k: sum(w in v for w in words) for k, v in FUNCTION_WORDS.items()}
    best = max(hits, key=lambda k: hits[k])
    if hits[best] and sorted(hits.values())[-1] > sorted(hits.values())[-2]:
        return best
    return "la" if len(words) >= 3 and latin >= 10 else ""


def _grams(text: str, k: int) -> set[str]:
    return {text[i : i + k] for i in range(len(text) - k + 1)}


@lru_cache(256)
def _question_grams(q: str) -> frozenset[str]:
    return frozenset(_grams(core(q), 3))


def _mask(text: str) -> str:
    return re.sub(r"(?<![A-Za-z])[A-Za-z]*\d[\dA-Za-z.\-]*", "0", text)


def _level(x: float) -> int:
    return int(min(10, max(0, x * 10 + 1e-9)))


# Words that decline, and words that offer something.
DECLINE = re.compile(
    r"不能|无法|没法|没办法|没有办法|不便|不会|拒绝|恕|不予|概不|没有权限|无权|不可以|无可奉告|难以|超出|不在我的|不在服务|选择不|不作|不做|爱莫能助|帮不|答不|说不了|给不了|满足不了|做不了|查不了|不清楚|不知道|沉默|没有资格|没有发言权|不谈|不讨论|不提供|未开放|不开放|难从命|违反|可说的|不归我|不管|别的吧"
    r"|can't|cannot|can not|unable|won't|will not|declin|not able|refuse|no answer|not allowed|not permitted|outside my|beyond|would rather not|not something i|nothing to (?:say|add)|don't (?:do|have|know|answer|talk)|do not (?:do|have|know|answer|talk)|falls outside|out of my|prevents? me|somebody else|someone else|something (?:else|different)|leave (?:that|this|it)|no (?:help|comment)|prefer not|off[- ]limits"
    r"|nicht|kein|ne peu[xt]|ne suis pas|refuse|pas en mesure|no pued|no me es posible|no voy|できません|かねます|できかね|お断り",
    re.I,
)
OFFER = re.compile(
    r"可以(?!就)|改用|改走|已为您|为您|帮您|安排|最快|优先|支持|建议|预计|可在|会有|申请|补发|退回|退款|寄"
    r"|you can|instead|offer|refund|replace|will (?:be|leave|ring|follow|arrive)|have moved|booked|stays|goes back|logged|draws|needs"
    r"|am \d|versand|rembours|envoi|saldrá|reembols|いたします|発送",
    re.I,
)
GROUPS = {"empty": "e", "copy": "p", "other_language": "p", "refusal": "n", "truncated": "t"}
DOUBT = 0.12  # sampled answers with such a score are not taken for sound
MIN_ROWS = 6  # a feature of fewer rows would only memorise them
KEEP = 0.3
PLAIN = 4096  # hashed numbers under this are kept for features that say more than one n-gram


def features(question: str | None, answer: str | None) -> dict[str, list[int]]:
    """Hashed feature numbers of a pair by group: emptiness, pair, n-grams, tail."""
    q, a = question or "", (answer or "").strip()
    bare = core(a)
    n = len(bare)
    nothing = n == 0 or bare in FILLERS or a.lower().strip(" .。!()（）[]【】-") in FILLERS or bool(_BRACKETED.fullmatch(a))
    size = n.bit_length()
    out: dict[str, list[str]] = {"e": [f"e{nothing}", f"l{min(size, 5)}{nothing}"]}
    # pair: overlap both ways, what the answer adds, language of both
    gq, ga = _question_grams(q), _grams(bare, 3)
    shared = len(gq & ga)
    inside, whole = shared / max(1, len(ga)), shared / max(1, len(gq))
    added = len(ga) - shared
    step = 0 if added <= 4 else 1 if added <= 9 else 2 if added <= 14 else 3 if added <= 20 else 4
    pair = []
    if gq and ga and not nothing:
        near = int(min(20, inside * 20 + 1e-9))
        pair += [f"i{near}", f"w{_level(whole)}", f"x{step}", f"ix{_level(inside)}{step}", f"iw{_level(inside)}{_level(whole) // 2}", f"ixw{near}{step}{whole > 0.25}"]
    lq, la = language(q), language(a)
    if lq and la and not nothing:
        latin = {"en", "de", "fr", "es", "la"}
        differ = lq != la and not ("la" in (lq, la) and {lq, la} <= latin)
        pair.append(f"m{differ}")
    out["p"] = pair
    # the end of the answer; a closed one says no more than that it is closed
    tail = a.rstrip()
    ellipsis = tail.endswith(("…", "..", "。。")) or bool(re.search(r"[:：]\s*\d\.$", tail))
    stop = "…" if ellipsis else tail[-1:] if tail[-1:] in END else ("w" if tail[-1:].isalnum() else "o")
    ends = [f"t{stop}"]
    if stop not in "。！？!?.~～" or nothing:
        broken = re.search(r"(?:<[|/a-z_]{0,12}|\|)$", tail)
        body = _mask(re.sub(r"(?:<[|/a-z_]{0,12}|\|)$", "", tail).rstrip(END + " "))
        ends += [f"k{bool(broken)}", f"zo{body[-1:].isalnum()}{la}", f"y{' '.join(re.findall(r'\w+|[^\w\s]', body)[-2:])}"]
        ends += [f"z{body[-k:]}" for k in range(1, 8) if len(body) >= k]
        ends.append(f"one{len(sentences_of(a)) > 1}")
    out["t"] = ends
    # n-grams of the answer and whether it declines or offers
    text = _mask(unicodedata.normalize("NFKC", a)).lower()
    said = len(sentences_of(a))
    no, yes = bool(DECLINE.search(text)), len(OFFER.findall(text))
    grams = [f"r{no}{min(yes, 2)}{min(said, 3)}", f"rc{no}{min(3, len(_CODE.findall(a)))}{min(size, 8)}", f"ry{no}{yes > 0}"]
    if la in ("zh", "ja", ""):
        grams += [f"g{text[i : i + k]}" for k in (2, 3) for i in range(len(text) - k + 1)]
    else:
        words = re.findall(r"[\w']+", text)
        grams += [f"u{w}" for w in words] + [f"u{v} {w}" for v, w in zip(words, words[1:])]
    out["n"] = [] if nothing else grams
    return {k: sorted({_number(f) for f in v}) for k, v in out.items()}


@lru_cache(1 << 18)
def _number(feature: str) -> int:
    h = zlib.crc32(feature.encode("utf-8", "surrogatepass"))
    return h % PLAIN if feature[0] == "r" else PLAIN + h % (DIM - PLAIN)


def sentences_of(a: str) -> list[str]:
    return [m.group() for m in _SENTENCE.finditer(a) if m.group().strip()] or [a]


_REFUSE = {
    "zh": (
        ["", "对不起，", "很抱歉，", "抱歉，", "不好意思，", "感谢您的提问，但", "收到您的消息，不过", "收到您的消息，但", "作为智能助手，", "身为一个语言模型，", "出于安全考虑，", "作为人工智能，", "谢谢咨询，但", "根据规定，", "按照相关要求，"],
        ["我无法{o}", "我不能{o}", "我没办法{o}", "我不便{o}", "我不会{o}", "我没法{o}", "我拒绝{o}", "我没有权限{o}", "恕不能{o}", "恕我无法{o}", "我不可以{o}", "这边不能{o}", "我选择不答", "难以{o}", "我没有办法{o}", "无可奉告", "恕不奉陪", "概不答复", "不予解答", "不予置评", "我帮不了您{o}", "我帮不上忙", "我答不了", "我给不了答复", "我满足不了您", "我说不了什么", "我查不了也不清楚", "我不知道怎么{o}", "我没有资格{o}", "我没有发言权", "我被要求不{o}", "本服务不提供{o}", "系统未开放{o}", "恕难从命", "我保持沉默", "这不归我管", "这里不谈这些", "没有什么可说的"],
        ["回答", "回答这个问题", "处理此类问题", "处理该请求", "评论此事", "讨论", "参与讨论", "回应该请求", "回应您的这个问题", "处理您的这个请求", "作答", "给出答案", "答复", "提供相关建议", "就{p}作出答复", "就{p}给出任何意见", "就{p}答复", "谈论{p}", "回答有关{p}的提问", "谈论这个话题", "完成这个请求", "说", "帮您"],
        ["", "请谅解", "望知悉", "请问点别的", "换个问题吧", "请咨询别处", "请另寻途径", "到此为止吧", "也不打算展开", "谢谢谅解", "请换个话题", "您另问他人", "您去问别人吧", "我们聊点别的吧", "请找有关部门", "请勿再问", "说了也不算"],
        ["", "", "这个问题超出了我的能力范围，", "您的提问不在我的服务范围，", "您的提问超出了我的能力范围，", "此类内容", "该类咨询", "这件事", "恕我直言，", "您问的这个", "关于{p}的事，", "关于{p}的提问，", "有关{p}，", "此类话题", "对此", "这个忙", "您的要求", "这类事情", "您说的内容违反规定，", "我只是一个程序，", "该话题不在讨论之列，", "很遗憾，"],
    ),
    "en": (
        ["", "I'm sorry, but ", "Sorry, ", "As an AI assistant, ", "Unfortunately, ", "Thank you for asking, but ", "I apologize, but "],
        ["I can't {o}", "I cannot {o}", "I am unable to {o}", "I'm not able to {o}", "I won't {o}", "I must decline to {o}", "I am not allowed to {o}", "I would rather not {o}", "No answer is available here", "This is outside what I can {o}", "Such matters are not for me to {o}", "We do not answer such questions", "I refuse to {o}", "I have nothing to say", "I don't have permission to {o}", "I do not {o}", "I'd prefer not to {o}", "this falls outside what I {o}", "my rules prevent me", "no comment", "let us leave that alone", "there is no help here"],
        ["help with that", "answer this question", "assist with this request", "comment on this matter", "discuss this topic", "provide that information", "respond to that", "answer", "discuss", "give an answer here", "go into this", "advise on the {p}", "talk about {p}"],
        ["", "please ask something else", "please try elsewhere", "that is all I can say", "thank you for understanding", "you'll have to ask someone else", "let's talk about something else"],
        ["", "", "That is outside my scope, ", "This question is beyond what I do, "],
    ),
    "de": (["", "Es tut mir leid, aber ", "Leider "], ["ich kann {o}", "kann ich {o}", "darf ich {o}", "ich möchte {o}"], ["dabei nicht helfen", "diese Frage nicht beantworten", "dazu nichts sagen", "diese Anfrage nicht bearbeiten"], ["", "bitte wenden Sie sich an andere Stellen", "danke für Ihr Verständnis"], [""]),
    "fr": (["", "Désolé, ", "Je suis désolé, mais "], ["je ne peux pas {o}", "je ne suis pas en mesure de {o}", "je refuse de {o}"], ["répondre à cette question", "vous aider", "traiter cette demande", "en parler"], ["", "merci de votre compréhension", "posez une autre question"], [""]),
    "es": (["", "Lo siento, ", "Lo siento, pero "], ["no puedo {o}", "no me es posible {o}", "no voy a {o}"], ["responder a esta pregunta", "ayudar con eso", "comentar este asunto", "atender esta solicitud"], ["", "gracias por su comprensión", "pregunte otra cosa"], [""]),
    "ja": (["", "申し訳ございませんが、", "恐れ入りますが、"], ["{o}"], ["その質問にはお答えできません", "お手伝いできません", "回答いたしかねます", "対応できかねます"], ["", "ご了承ください"], [""]),
}
_PARTIAL = {
    "zh": ["抱歉，这款无法使用券{c}，您可以改用满减。", "很抱歉，{p}无法当天发出，最快{d}寄出。", "由于快递停运，我们没办法保证{d}送达，已为您改走其他线路。", "抱歉，{p}暂时不能改地址，您可以在订单页申请拦截。", "因为仓库盘点，我们无法保证{d}送达，会优先安排。", "对不起，{p}不支持退换，可以为您安排维修。", "不好意思，这张券不能叠加，我帮您换成{c}。"],
    "en": ["Sorry, we cannot ship the {p} today, it leaves on {d}.", "We are unable to apply code {c}, but you can use the store discount instead.", "Unfortunately the {p} is out of stock, we can offer a refund or a replacement.", "I'm sorry for the delay, we cannot promise {d} but have moved the parcel to another carrier."],
    "de": ["Leider können wir {p} heute nicht versenden, der Versand erfolgt am {d}."],
    "fr": ["Désolé, nous ne pouvons pas expédier {p} aujourd'hui, l'envoi part le {d}."],
    "es": ["Lo siento, no podemos enviar {p} hoy, saldrá el {d}."],
    "ja": ["申し訳ございませんが、{p}は本日発送できません、{d}に発送いたします。"],
}
_CONNECT = {"zh": ["，具体步骤如下：1.", "：1.", "，并且", "，然后请您", "，如果", "，因为", "，同时", "，但是", "，另外请", "，所以"], "en": [". The steps are: 1.", ", which means", ", and", ", because the", ", but you", " and then please", ", so that"], "de": [", und", ", weil"], "fr": [", et", ", car"], "es": [", y", ", porque"], "ja": ["、そして", "ので、"]}
_NOUN = re.compile(r"[一-鿿]{1,6}[A-Z0-9][A-Z0-9\-]{3,9}|[A-Z][a-z]+ [A-Z0-9\-]*\d[A-Z0-9\-]*(?: [a-z]+)?|[A-Z0-9\-]{5,}")


class Forge:
    """Makes synthetic pairs from sampled ones, deterministically for a seed."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def noun(self, q: str, a: str) -> str:
        found = _NOUN.findall(q) or _NOUN.findall(a)
        return self.r.choice(found) if found else self.r.choice(["这个", "it", "X100"])

    def truncated(self, a: str, lang: str) -> str | None:
        marks = "，。！？,.!?；;：:、\n ~～"
        at = [i for i in range(max(3, len(a) // 8), len(a) - 2) if a[i] not in marks and a[i - 1] not in marks]
        if not at:
            return None
        cut = a[: self.r.choice(at)]
        roll = self.r.random()
        if roll < 0.15:
            return cut + "…"
        if roll < 0.2:
            return cut + "..."
        if roll < 0.35:
            return cut + "<|"
        if roll < 0.5:
            whole = self.sentences(a)
            return "".join(whole[: self.r.randint(1, len(whole))]).rstrip(END + " ") + self.r.choice(_CONNECT.get(lang) or _CONNECT["en"])
        return cut

    def sentences(self, a: str) -> list[str]:
        return sentences_of(a)

    def complete(self, a: str, lang: str) -> str:
        """A sound answer: whole sentences, now and then without the last mark or with a polite end."""
        parts = self.sentences(a)
        k = self.r.randint(1, len(parts))
        text = "".join(parts[:k]) if self.r.random() < 0.7 else "".join(parts[-k:])
        roll = self.r.random()
        if roll < 0.6:
            return text.rstrip(END + " \n")
        if roll < 0.85:
            return text + self.r.choice(POLITE.get(lang) or POLITE["en"])
        return text

    def copy(self, q: str, lang: str) -> str:
        lead = {"zh": ["您问的是：", "用户：", "亲，", "问题：", "您好，", ""], "ja": ["ご質問：", ""]}.get(lang, ["You asked: ", "Question: ", "User: ", ""])
        roll = self.r.random()
        text = q
        if roll < 0.15:
            text = q + self.r.choice(["", " ", "\n"]) + q
        elif roll < 0.35:
            parts = self.sentences(q)
            self.r.shuffle(parts)
            text = "".join(parts[: max(1, len(parts) - (self.r.random() < 0.5))])
        elif roll < 0.55 and len(q) > 8:
            chars = list(q)
            for _ in range(self.r.randint(1, max(1, len(q) // 12))):
                i = self.r.randrange(len(chars))
                chars[i] = self.r.choice(["", chars[i] + chars[i], self.r.choice(q)])
            text = "".join(chars)
        elif roll < 0.7:
            text = q.replace("，", "、").replace("？", "。").replace(", ", " ")
        if self.r.random() < 0.15:
            text = text.rstrip(END) + self.r.choice({"zh": ["呀", "呢", "哦", "吗"]}.get(lang, ["", "?"]))
        return self.r.choice(lead) + text if self.r.random() < 0.5 else text

    def quoted(self, q: str, a: str, lang: str) -> str:
        parts = self.sentences(q)
        said = parts[self.r.randrange(len(parts))] if self.r.random() < 0.6 else q
        lead = {"zh": ["您问“{s}”，", "您说的“{s}”，", "关于您说的“{s}”，放心，", "{s} 这个问题："]}.get(lang, ['You asked "{s}": ', 'About "{s}", ', '"{s}" '])
        tail = "".join(self.sentences(a)[: self.r.randint(1, 2)])
        return self.r.choice(lead).format(s=said.replace("{", "").replace("}", "")) + tail

    def refusal(self, q: str, a: str, lang: str) -> str:
        lead, cannot, what, end, scope = _REFUSE.get(lang) or _REFUSE["en"]
        pick = self.r.choice
        text = pick(scope) + pick(lead) + pick(cannot).replace("{o}", pick(what)) if self.r.random() < 0.7 else pick(lead) + pick(scope) + pick(cannot).replace("{o}", pick(what))
        tail = pick(end)
        comma = "，" if lang in ("zh", "ja") else ", "
        stop = self.r.choice(["。", "。", "！", ""]) if lang in ("zh", "ja") else self.r.choice([".", ".", "!", ""])
        return text.replace("{p}", self.noun(q, a)) + (comma + tail if tail else "") + stop

    def partial(self, q: str, a: str, lang: str) -> str:
        day = f"{self.r.randint(1, 12)}月{self.r.randint(1, 28)}日" if lang == "zh" else f"May {self.r.randint(1, 28)}"
        code = "".join(self.r.choices("ABCDEFGHJKLMNPQRSTUVWXYZ", k=3)) + str(self.r.randint(10000, 99999))
        text = self.r.choice(_PARTIAL.get(lang) or _PARTIAL["en"]).format(p=self.noun(q, a), d=day, c=code)
        return text + ("".join(self.sentences(a)[: self.r.randint(1, 2)]) if self.r.random() < 0.6 else "")

    def empty(self) -> str:
        f = sorted(FILLERS)
        return self.r.choice(["", " ", "\n\n", "　", "\t \xa0", "……", "...", "。", "-", "--", "<br/>", "<p></p>", "&nbsp;", "？", "[表情]", *self.r.choices(f, k=8), self.r.choice(f).upper(), f"（{self.r.choice(f)}）", f"{self.r.choice(f)}。"])


def synthesise(pairs: list[tuple[str, str]], seed: int) -> tuple[list[tuple[str, str]], list[str]]:
    """Synthetic pairs and their labels ('' for sound) from pairs taken for sound."""
    forge = Forge(seed)
    by_lang: dict[str, list[str]] = {}
    for _, a in pairs:
        by_lang.setdefault(language(a), []).append(a)
    # whatever the sample lacks is made of the phrases kept here
    for lang, phrases in _PARTIAL.items():
        by_lang.setdefault(lang, []).extend(p.format(p="X100", d="5", c="ABC123") for p in phrases)
    out, labels = [], []

    def put(q: str, a: str | None, label: str) -> None:
        if a is not None:
            out.append((q, a))
            labels.append(label)

    for q, a in pairs:
        lang = language(a) or language(q) or "zh"
        put(q, a, "")
        put(q, forge.complete(a, lang), "")
        if forge.r.random() < 0.5:
            put(q, forge.complete(a, lang), "")
        put(q, forge.truncated(a, lang), "truncated")
        if forge.r.random() < 0.5:
            put(q, forge.truncated(a, lang), "truncated")
        roll = forge.r.random()
        if roll < 0.35:
            put(q, forge.refusal(q, a, language(q) or lang), "refusal")
            put(q, forge.refusal(q, a, language(q) or lang), "refusal")
        elif roll < 0.6:
            put(q, forge.copy(q, language(q) or lang), "copy")
        elif roll < 0.75:
            other = [k for k in sorted(by_lang) if k and k != language(q)]
            if other and language(q):
                put(q, forge.r.choice(by_lang[forge.r.choice(other)]), "other_language")
        elif roll < 0.85:
            put(q, forge.empty(), "empty")
        roll = forge.r.random()
        if roll < 0.25:
            put(q, forge.partial(q, a, lang), "")
        elif roll < 0.45:
            put(q, forge.quoted(q, a, lang), "")
    return out, labels


class Classifier:
    """One logistic model per label over the hashed features of its group, with calibrated thresholds."""

    def __init__(self) -> None:
        self.weights = np.zeros((len(LABELS), DIM + 1))
        self.thresholds = np.full(len(LABELS), 0.5)

    @staticmethod
    def _sparse(rows: list[dict[str, list[int]]], group: str) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r[group]) for r in rows]), np.fromiter((c for r in rows for c in r[group]), np.int64)

    def scores(self, rows: list[dict[str, list[int]]]) -> np.ndarray:
        out = np.zeros((len(rows), len(LABELS)))
        made: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for k, label in enumerate(LABELS):
            g = GROUPS[label]
            at, cols = made.setdefault(g, self._sparse(rows, g))
            w = self.weights[k]
            out[:, k] = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[cols], minlength=len(rows)) + w[DIM], -30, 30)))
        return out

    def train(self, rows: list[dict[str, list[int]]], labels: list[str], seed: int, rounds: int = 120) -> None:
        """Gradient descent with momentum and per-weight steps; sound rows weigh ``SOUND_WEIGHT``; a
        quarter is held out to calibrate the thresholds by weighted F1."""
        order = np.random.default_rng(seed).permutation(len(rows))
        held, used = order[: len(rows) // 4], order[len(rows) // 4 :]
        y = np.array(labels)
        own = [rows[i] for i in used]
        made: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for k, label in enumerate(LABELS):
            g = GROUPS[label]
            if g not in made:
                at, cols = self._sparse(own, g)
                often = np.bincount(cols, minlength=DIM)[cols] >= MIN_ROWS
                used_cols, place = np.unique(cols[often], return_inverse=True)
                made[g] = at[often], place, used_cols
            # weights only for the columns that occur; all others stay 0
            at, cols, known = made[g]
            dim = known.size
            target = (y[used] == label).astype(float)
            weight = np.where(y[used] == "", SOUND_WEIGHT, 1.0) if label != "truncated" else np.ones(len(used))
            if label == "refusal":  # a refusal cut short is still one: cut answers say nothing here
                weight = np.where(y[used] == "truncated", 0.0, weight)
            rng = np.random.default_rng(seed + k)
            w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
            common = known[cols] < PLAIN
            for t in range(1, rounds + 1):
                if g == "n":  # most n-grams are hidden: new wordings must be told by the rest
                    seen = common | (rng.random(len(cols)) < KEEP)
                    at_, cols_ = at[seen], cols[seen]
                else:
                    at_, cols_ = at, cols
                z = np.bincount(at_, w[cols_], minlength=len(own)) + w[dim]
                e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
                grad = np.append(np.bincount(cols_, e[at_], minlength=dim), e.sum()) / len(own) + 1e-5 * w
                m = 0.9 * m + 0.1 * grad
                v = 0.99 * v + 0.01 * grad**2
                w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
            if g == "n":
                w[:dim][known >= PLAIN] *= KEEP
            self.weights[k] = 0.0
            self.weights[k, known], self.weights[k, DIM] = w[:dim], w[dim]
        score = self.scores([rows[i] for i in held])
        for k, label in enumerate(LABELS):
            truth = y[held] == label
            cost = np.where(y[held] == "", SOUND_WEIGHT, 1.0)
            grid = np.arange(0.15, 0.95, 0.05)
            f1 = []
            for t in grid:
                said = score[:, k] >= t
                hit = float((said & truth).sum())
                f1.append(2 * hit / max(1.0, 2 * hit + float((cost * (said & ~truth)).sum()) + float((~said & truth).sum())))
            # the lowest threshold about as good as the best: real defects look less typical than forged ones
            self.thresholds[k] = float(grid[np.array(f1) >= max(f1) - 0.015][0])

    def decide(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The likeliest label over its threshold; another language is never read as cut off."""
        score = self.scores([features(q, a) for q, a in pairs]) if pairs else np.zeros((0, len(LABELS)))
        out: list[str | None] = []
        for (_, a), row in zip(pairs, score):
            over = np.nonzero(row >= self.thresholds)[0]
            if not core(a):
                out.append("empty")
            elif not len(over):
                out.append(None)
            else:
                sure = [k for k in over if LABELS[k] in ("empty", "other_language")]
                out.append(LABELS[sure[0] if sure else over[np.argmax(row[over])]])
        return out


def fit(pairs: list[tuple[str, str]], seed: int = 13) -> Classifier:
    """Crosswise cleaning, then the final fit.

    Sampled answers hold real defects. Each half of the sample is judged by a model of the other half:
    what that finds broken is no longer taken for sound, and its refusals join the synthetic ones.
    """
    model = Classifier()
    # one row per answer: a refusal in stock wording must not count as often as it is given
    sound = list({core(a): (q, a) for q, a in pairs if q and a and len(core(a)) >= 8}.values())
    extra: list[tuple[str, str]] = []
    halves = [sound[::2], sound[1::2]]
    clean: list[tuple[str, str]] = []
    for mine, other in (halves, halves[::-1]):
        if not other:
            clean += mine
            continue
        made, labels = synthesise(other, seed)
        model.train([features(q, a) for q, a in made], labels, seed)
        score = model.scores([features(q, a) for q, a in mine])
        extra += [p for p, z in zip(mine, score[:, LABELS.index("refusal")]) if z >= 0.3]
        clean += [p for p, z in zip(mine, score) if (z < np.minimum(model.thresholds, DOUBT)).all()]
    if clean:
        made, labels = synthesise(clean, seed + 1)
        made += extra * 5
        labels += ["refusal"] * (5 * len(extra))
        model.train([features(q, a) for q, a in made], labels, seed)
    return model


def _apply(model: Classifier):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = model.decide(list(zip(pdf["question"], pdf["answer"])))
            out = pdf[["table_name", "record_id", "field_name"]].assign(defect=said)
            yield out[out["defect"].notna()]

    return run


def _question(prompt: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(F.regexp_replace(prompt, r"(?U)\s+", ""), F.lit("")) == "", fallback).otherwise(prompt)


def preference_answers(df: DataFrame) -> DataFrame:
    users = F.filter(F.coalesce("messages", F.array()), lambda m: m["role"] == "user")
    question = _question(F.col("prompt"), F.when(F.size(users) > 0, F.element_at(users, -1)["content"]))
    both = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("answer")) for f in ("chosen", "rejected")])
    return df.select(F.lit("dpo_preference_pairs").alias("table_name"), F.col("id").cast("string").alias("record_id"), question.alias("question"), F.explode(both).alias("x")).select(
        "table_name", "record_id", "x.field_name", "question", "x.answer"
    )


def generation_answers(df: DataFrame) -> DataFrame:
    h = F.coalesce("history", F.array())
    last = F.when(F.size(h) > 0, F.get(F.element_at(h, -1), F.lit(0)))
    return df.select(
        F.lit("post_train_test_generations").alias("table_name"), F.col("id").cast("string").alias("record_id"), F.lit("generated_reply").alias("field_name"), _question(F.col("prompt"), last).alias("question"), F.col("generated_reply").alias("answer")
    )


def broken_answers(answers: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(table_name, record_id, field_name, defect) of every defective answer."""
    answers = answers.filter("record_id is not null")
    whole = answers.filter("question is not null and answer is not null")
    got = C.hash_sample(whole, [F.col("record_id"), F.col("field_name"), F.col("answer")], rows).select("record_id", "field_name", "question", "answer").collect()
    sample = [r[2:] for r in sorted(got)]
    model = fit([(r[0], r[1]) for r in sample])
    found = answers.mapInPandas(_apply(model), "table_name string, record_id string, field_name string, defect string")
    return found.groupBy("table_name", "record_id", "field_name").agg(F.min("defect").alias("defect"))


def defect_report(found: DataFrame) -> DataFrame:
    return found.groupBy("table_name", "field_name", "defect").agg(F.count(F.lit(1)).alias("n"))
