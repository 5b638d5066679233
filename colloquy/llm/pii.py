"""Problem 3: personal information inside free text.

Method: weak supervision. Patterns propose spans; several labelers (shape, checks, gazetteers,
context before and after, neighbouring spans) vote for, against or abstain. Expectation-maximisation
over the votes estimates how reliable each labeler is, per type; the resulting soft labels train a
logistic span classifier on the votes and on hashed characters of the span and its surroundings.
The classifier decides.

Everything is proposed and decided on whole texts of all rows. Only the two models are fitted on a
bounded sample of proposed spans: about ``FIT_ROWS`` per type, chosen by hash.

Widths are levelled character by character first (positions do not move), so spans in full-width
characters are found and replaced in place.

Defined results: null and empty texts hold nothing; rows delivered twice give one result per id;
null ids are left out; null messages have no turns; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from . import common as C

TYPES = ("email", "phone", "id_number", "address", "name")
FIT_ROWS = 6_000
HASHED = 2048
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_LATIN = re.compile("[a-zà-ÿ]{2} |^[A-Za-z]|[a-z]{3}")

# Frequent Chinese family names.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤萧凌傅倪施葛柳康齐乔庄樊兰殷章温童颜梅盛霍翟鲁聂洪纪柯舒骆俞祝费岑喻卓蓝向"
)
COMPOUND = ("欧阳", "司马", "上官", "诸葛", "司徒", "东方", "皇甫", "尉迟", "夏侯", "慕容")
# Function characters that do not stand in given names, and first-word traps of the isolated form.
NOT_GIVEN = set("的了是在不我你他她它们这那有没和与或及就都也还要会能可以请问吗呢吧啊哦嗯被把给对从到向于为因所如但而且再又才很太更最这些什么怎样多少几何时候号单件次天个元月日年点分钟区市县镇街路弄栋楼室箱包袋里外上下前后左右先生女士谢好")

_WIDTH = {c: c - 0xFEE0 for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)}
_WIDTH |= {ord(c): ord(d) for c, d in zip("＠．＋＿　 －–—−‐‑＃", "@.+_  ------#")}
_WIDE = re.compile("[" + "".join(map(chr, _WIDTH)) + "]")
_CN = "零〇一二三四五六七八九幺"

_LOCAL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*"
_AT = r" ?(?:@|[(（\[{]at[)）\]}]|#at#|<at>|艾特) ?"
_DOT = r"(?: ?(?:\.|[(（\[{]dot[)）\]}]|#dot#|点) ?| dot )"
EMAIL = re.compile(
    rf"{_LOCAL}{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}|{_LOCAL} at [A-Za-z0-9\-]+(?: dot [A-Za-z0-9\-]+)*(?: dot |\.)[A-Za-z]{{2,}}(?<! dot )(?![A-Za-z0-9])",
    re.I,
)
_SPELLED = re.compile(r" at [A-Za-z0-9\-]+\.", re.I)
_CNX = "[" + _CN + "]"
RUN = re.compile(r"(?:[+(（]{1,2}\d|\d)[\d \-.·()（）]{5,}[\dXx]")
PHONE = re.compile(
    r"(?<![A-Za-z0-9*.\-])(?:[(（]?\+86[)）]?[ \-]?|0086[ \-]?|[(（]?86[)）]?[ \-])?1[3-9](?:[ .·\-]?\d){9}(?![A-Za-z0-9*]|-\d)"
    r"|(?<![A-Za-z0-9*.\-])861[3-9]\d{9}(?![A-Za-z0-9*]|-\d)"
    r"|(?<![A-Za-z0-9*.\-])(?:\+86[ \-]?)?[(（]?0(?:10|2\d|[3-9]\d{2})[)）]?[ \-]?\d{3,4}[ \-]?\d{4}(?![A-Za-z0-9*]|-\d)"
    r"|\+\d{1,3}[ \-.]?(?:[(（]\d{2,4}[)）][ \-.]?)?\d{2,4}(?:[ \-.]?\d{2,5}){1,4}(?![A-Za-z0-9*])"
    r"|(?<![A-Za-z0-9*.\-])[(（][2-9]\d{2}[)）] ?\d{3}[\-. ]\d{4}(?!\d)|(?<![A-Za-z0-9*.\-])[2-9]\d{2}[\-.][2-9]\d{2}[\-.]\d{4}(?![A-Za-z0-9*]|-\d)"
    r"|(?<![A-Za-z0-9*.\-])[2-9]\d{2}-\d{4}(?![A-Za-z0-9*]|-\d)"
)
PHONE_CN = re.compile(rf"(?<!{_CNX})[一幺][三四五六七八九](?:[ \-]?{_CNX}){{9}}(?!{_CNX})")
CARD = re.compile(r"(?<![A-Za-z0-9*\-])\d{6}[ \-]?(?:\d{3}[ \-]?)?(?:19|20)\d{2}[ \-]?(?:0[1-9]|1[0-2])[ \-]?(?:0[1-9]|[12]\d|3[01])[ \-]?\d{3}[\dXx](?![A-Za-z0-9*])|(?<![A-Za-z0-9*\-])\d{3}-\d{3}-\d{8}-\d{3}[\dXx](?![A-Za-z0-9*])|(?<![A-Za-z0-9*\-])(?!000)\d{3}-\d{2}-\d{4}(?![A-Za-z0-9*]|-\d)")
PASSPORT = re.compile(r"(?<![A-Za-z0-9])(?:[EGDSP][A-Z]?\d{7,8}|[A-Z]\d{8}|[A-Z]{2}\d{7})(?![A-Za-z0-9])")
_NUM = r"(?:\d{1,5}|[一二三四五六七八九十百]{1,4})"
_REST = r"(?:[ ,，]{0,2}[一-鿿]{0,6}? ?" + _NUM + r" ?(?:号楼|号|栋|幢|座|楼|单元|层|室|户)){0,4}(?:[ ,，]{0,2}[一-鿿]{2,6} ?\d{1,3}-\d{2,4})?(?: ?\d{2,5})?(?: ?室)?(?:[东西南北]户)?"
ADDRESS = re.compile(
    r"(?:路|街|大道|巷|弄|里|胡同|道) ?" + _NUM + r" ?(?:号|弄)" + _REST
    + r"|(?:小区|花园|公寓|新村|苑|家园|里|城|湾) ?" + _NUM + r" ?(?:号楼|栋|幢|座|楼)" + _REST
    + r"|(?:小区|花园|公寓|新村|苑|家园) ?\d{1,3}-\d{1,4}(?:-\d{2,4})?(?!\d)|里 ?\d{1,3}-(?:\d{1,3}-)?\d{3,4}(?!\d)"
)
_LEFT = re.compile(r"(?:[一-鿿]{2,8}[省市区县镇] ?){0,3}[一-鿿]{1,8}$")
_LEAD = re.compile(r"^.*(?:住在|家在|家住|寄到|寄往|送到|送往|地址是|地址|改成|改为|登记(?:的是|为|在)?|记(?:的是|为)|收货地|住)")
ADDRESS_EN = re.compile(
    r"(?<![A-Za-z0-9])\d{1,5}[A-Za-z]? (?:[A-Z][\w'’\-]+ ){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Court|Ct|Boulevard|Blvd|Way|Terrace|Place|Pl|Square|Close|Crescent|Row|Hill|Parkway|Alley|Walk|Mews|Quay)\b\.?"
    r"|(?<![A-Za-z])(?:[A-ZÄÖÜ][a-zäöüß]+[ \-])?[A-ZÄÖÜ][a-zäöüß]*(?:straße|strasse|str\.|weg|gasse|platz|allee) \d{1,4}[a-z]?\b"
    r"|(?<![A-Za-z])\d{1,4},? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse) (?:d[eu']s? ?|la |les |l')*[A-ZÀ-Ý][\w'’\-]+|(?<![A-Za-z])(?:[Cc]alle|Avenida|Avda\.|Paseo|Plaza|Camino) (?:de |del |la |las |los )*[A-ZÁÉÍÓÚÑ][\w'’\-]+(?: [A-ZÁÉÍÓÚÑ][\w'’\-]+)*,? (?:n\.º )?\d{1,4}"
    r"|\d{1,3}丁目\d{1,3}(?:番(?:地)?)?\d{0,3}号?"
)
_HAN = "一-鿿"
_CUE_ZH = "本人是|本人|我叫|我是|我姓名|收件人是|收件人|收货人|联系人是|联系人|登记人是|登记人|账户名是|账户名|户名是|户名|姓名是|姓名|名字是|名字叫|名叫|收货信息|核对信息|联系人写|收件人写|名字写|收信人|签收人|申请人|持卡人|改为|清关|报关|实名|寄件人|开户人|真实姓名|机主"
_SUR = f"(?:{'|'.join(COMPOUND)}|[{SURNAMES}])"
NAME_CUED = re.compile(f"(?:{_CUE_ZH})[:：是为叫 ]{{0,2}}({_SUR}[{_HAN}]{{1,2}})(?![{_HAN}])|(?:{_CUE_ZH})[:：是为叫 ]{{0,2}}({_SUR}[{_HAN}]{{1,2}}?)(?=收|住|的|，|先生|女士)")
NAME_ALONE = re.compile(f"(?<![{_HAN}A-Za-z0-9])({_SUR}[{_HAN}]{{1,2}})(?![{_HAN}])|(?<![{_HAN}A-Za-z0-9])({_SUR}[{_HAN}]{{1,2}}?)(?=收(?![{_HAN}])|先生|女士|小姐)")
NAME_LATIN = re.compile(r"(?<![\w'’])[A-ZÀ-Ý][a-zà-ÿ'’]+(?: [A-Z]\.)? [A-ZÀ-Ý][a-zà-ÿ'’]+(?:-[A-ZÀ-Ý][a-zà-ÿ]+)?(?![\w'’])")

_CUE = {
    "email": re.compile(r"邮箱|邮件|发到|发至|送到|发我|mail|reach|write to|contact|<$", re.I),
    "phone": re.compile(r"电话|手机|号码|联系|致电|拨打|打我|预留|短信|座机|机主|phone|call|tel|mobile|cell|number is|ring|reach|text", re.I),
    "id_number": re.compile(r"证|身份|清关|报关|实名|护照|passport|SSN|social|customs|\bid\b|Ausweis|DNI", re.I),
    "address": re.compile(r"住|家在|家住|寄到|寄往|送到|送往|地址|收货地|收货|改成|改为|登记的是|live at|lives at|address|ship to|deliver|send (?:it )?to|wohne|Adresse|habite|adresse|vivo en|dirección|住所", re.I),
    "name": re.compile(f"(?:{_CUE_ZH}|this is|name is|i am|i'm|my name|for|signed|attn|regards|ich bin|mein name ist|je m'appelle|je suis|me llamo|soy|mi nombre es|name)[:：,是为叫 ]*$", re.I),
}
_CODE = re.compile(r"(?:订单|单号|运单|快递单|工单|单子|退款单|退货单|返修单|售后单|会话|编号|批次|批号|序列号|货号|型号|款号|码|券|流水|凭证|单据|支付号|柜号|会员号|账号|账户|尾码|参考|详见|登记号|回执|受理号|文件名|热线|order|tracking|parcel|batch|case|code|voucher|serial|invoice|form|number|note|booking|ticket|ref|item)(?:里的|号|为|是|:|：|#|no\.?)*[ #]*[A-Za-z]*$", re.I)
_AFTER = {
    "email": re.compile(r"^(?:是我的邮箱|这个邮箱|，请查收|，注意|>)"),
    "phone": re.compile(r"^[，, ]*(?:到了打|打不通|别|对吗|没错|就行|收|，[一-鿿]{2,5}[区市])"),
    "id_number": re.compile(r"^[，, ]*(?:就行|对吗|已通过|需重传|需要重传|没错)"),
    "address": re.compile(r"^[，, ]*(?:别|就行|收|对吗|没错|[一-鿿]{2,4}[（(]?收)"),
    "name": re.compile(r"^(?:[，, ]*(?:住|家在|收|[（(]收|先生|女士|\+?\d[\d \-]{6,}|[一幺][" + _CN + r"]{6}|没错|[（(]?\+)| ?<)"),
}


def level(text: str) -> str:
    """Full-width letters and digits, dashes and blanks to plain ones, character by character."""
    return text.translate(_WIDTH) if _WIDE.search(text) else text


def _check_digit(d: str) -> bool:
    s = sum(int(c) * (1 << (17 - i)) for i, c in enumerate(d[:17])) % 11
    return "10X98765432"[s] == d[17].upper()


@cache
def _common_pairs() -> set[str]:
    """Two- and three-character clauses that begin like a family name and are none."""
    return set("谢谢 高兴 安排 方便 马上 周末 周一 周二 周三 周四 周五 周六 周日 任何 白色 黄色 石头 金额 江苏 江西 万一 向您 时间 常见 成功 方案 方式 于是 何时 何必 余额 程序 高度 许多 严重 范围 夏季 秦皇岛 龙头 田园 杜绝 贺卡 雷雨 陆续 陶瓷 毛毯 毛病 顾客 应该 关于 包裹 包装 费用 温度 温馨".split())


def spans(raw: str) -> list[tuple[str, int, int, list[int], list[str]]]:
    """Proposed spans of a text: (type, start, end, votes, features).

    Votes are 1 for, 0 against, -1 abstain, by seven labelers: shape, check, gazetteer, cue before,
    cue after, code context, neighbour.
    """
    text = level(raw)
    out: list[tuple[str, int, int, list[int], list[str]]] = []

    def add(kind: str, a: int, b: int, shape: int, check: int, gaz: int, extra: list[str]) -> None:
        before, after = text[max(0, a - 14) : a], text[b : b + 14]
        cue = 1 if _CUE[kind].search(before[-12:]) else -1
        follow = 1 if _AFTER[kind].search(after) else -1
        code = 0 if kind not in ("email", "address") and _CODE.search(before) and not (kind == "phone" and re.search("号码|电话|手机", before[-6:])) else -1
        near = [f"b{before[-1:]}", f"a{after[:1]}", f"B{before[-2:]}", f"A{after[:2]}", *extra]
        out.append((kind, a, b, [shape, check, gaz, cue, follow, code, -1], near))

    if "@" in text or "at" in text or "AT" in text or "艾特" in text:
        for m in EMAIL.finditer(text):
            plain = "@" in m.group()
            add("email", *m.span(), 0 if _SPELLED.search(m.group()) else 1, 1 if plain else -1, -1, ["plain" if plain else "spelled"])
    for run in RUN.finditer(text):
        # a card first: what is left of the run may hold a phone number
        end, taken = run.end(), []
        if text[end : end + 1] == "*" or text[end : end + 1].isalnum() and text[end : end + 1].isascii():
            end -= 1  # the last number of the run goes on as a code
        for m in CARD.finditer(text, run.start(), end):
            s, (a, b) = m.group(), m.span()
            d = re.sub(r"[^\dXx]", "", s)
            if len(d) == 18:
                good = _check_digit(d)
                named = not good and _CODE.search(text[max(0, a - 14) : a]) and not _CUE["id_number"].search(text[max(0, a - 8) : a])
                add("id_number", a, b, 0 if named else 1, int(good), 0 if named else -1, ["id18"])
            else:
                add("id_number", a, b, 1, 1, -1, ["ssn"])
            taken.append((a, b))
        for m in PHONE.finditer(text, run.start(), end):
            s, (a, b) = m.group(), m.span()
            if any(x < b and a < y for x, y in taken):
                continue
            d = re.sub(r"\D", "", s)
            bare = s.isdigit()
            coded = _CODE.search(text[max(0, a - 14) : a]) and not re.search("号码|电话|手机", text[max(0, a - 6) : a])
            named = coded and (bare or len(d) == 7)  # a code of the shop by its own name
            add("phone", a, b, 0 if named else 1, 0 if named else -1, 0 if named else (-1 if bare else 1), [f"d{len(d)}", "run" if bare else "cut", *(["named"] if named else [])])
    for m in PHONE_CN.finditer(text):
        add("phone", *m.span(), 1, -1, 1, ["d11", "words"])
    for m in PASSPORT.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()]
        if m.group()[0] in "EG" and m.group()[1].isdigit() or re.search("护照|passport|pasaporte|passeport|Reisepass", before, re.I):
            known = 1 if re.search("护照|passport|证件|pasaporte|passeport|Reisepass", before, re.I) else 0
            add("id_number", *m.span(), 1, known, -1, ["pass"])
    for m in ADDRESS.finditer(text):
        left = _LEFT.search(text[max(0, m.start() - 30) : m.start()])
        lead = _LEAD.search(left.group()) if left else None
        a, b = m.start() - (len(left.group()) if left else 0) + (lead.end() if lead else 0), m.end()
        s = text[a:b]
        rooms = len(re.findall(r"[号栋幢座楼室户弄]|单元|\d-\d", s))
        odd = 0 if re.search("订单|单号|批次|编号|型号|券|预计|发出|以内|工作日", s) else -1
        shape = 1 if left else 0  # a street or an estate without a name
        add("address", a, b, shape, shape and (1 if rooms >= 2 else -1), 1 if odd < 0 and re.search("[区市县]", s) else odd, [f"r{min(rooms, 3)}"])
    latin = _LATIN.search(text) is not None
    for m in ADDRESS_EN.finditer(text) if latin or "丁目" in text else ():
        add("address", *m.span(), 1, 1, 1, ["latin"])
    places = [(x[1], x[2]) for x in out if x[0] == "address"]
    seen: set[int] = set()
    for pattern, cued in ((NAME_CUED, True), (NAME_ALONE, False)):
        for m in pattern.finditer(text):
            g = 1 if m.group(1) else 2
            a, b = m.span(g)
            s = m.group(g)
            if a in seen:
                continue
            seen.add(a)
            given = s[2:] if s[:2] in COMPOUND else s[1:]
            other = s in _common_pairs() or s[-1] in "区市县镇村" or any(x < b and a < y for x, y in places)
            bad = other or any(c in NOT_GIVEN for c in given)
            add("name", a, b, 0 if bad else 1, 0 if other else -1, 0 if bad else 1, [f"g{c}" for c in given] + [f"s{s[0]}", f"n{len(s)}", "zh", *(["other"] if other else [])])
    for m in NAME_LATIN.finditer(text) if latin else ():
        a, b = m.span()
        words = m.group().rstrip(".").split(" ")
        other = any(x - 2 <= b and a <= y + 2 for x, y in places)  # part of a street or a town
        bad = other or any(w in _NOT_LATIN for w in words) or text[b : b + 1] == "-" or re.match(r" (?:[A-Z0-9\-]*\d|Road|Street|Lane|Avenue|Drive|Way)", text[b:])
        add("name", a, b, 0 if bad else 1, 0 if other else -1, 0 if other else -1, ["latin", *(["other"] if other else [])])
    # neighbours: a span of another type within a few characters speaks for a name or an address
    spots = sorted((x[1], x[2], x[0]) for x in out)
    for x in out:
        if x[0] in ("name", "address", "phone"):
            close = spots[bisect.bisect_left(spots, (x[1] - 120,)) : bisect.bisect_right(spots, (x[2] + 5,))]
            near = any(k != x[0] and (k != "name" or x[0] != "name") and (0 <= p - x[2] <= 4 or 0 <= x[1] - q <= 6) for p, q, k in close)
            x[3][6] = 1 if near else (0 if x[0] == "name" and x[3][3] < 0 and x[3][4] < 0 else -1)
    return out


# Capitalised words that open sentences or name things, not persons.
_NOT_LATIN = set(
    "The This That These Those There Your Our My His Her Its We You They It He She One Two Three Please Thank Thanks Dear Hello Hi Good Morning Evening Afternoon Order Tracking Number Support Customer Service Team Agent Case Photo Photos Return Refund Invoice Warranty Voucher Code Batch Serial Parcel Courier January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Sehr Guten Tag Bonjour Hola Buenos Kind Best Regards Sincerely For To In On At From Where When What Why How Can Could Would Is Are Do Does Did Has Have Had And But Or If As Our Reply Here Port Upper Lower Old New North South East West Street Road Lane Avenue Drive Way Court St Ave Rd Ln Dr Square Terrace Row Very Much Außerdem Für Wir Ihre Der Die Das El La Los Las Le Les Nous Votre Vous".split()
)


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for rid, field, turn, key, text in zip(pdf["record_id"], pdf["field_name"], pdf["turn_no"], pdf["text_key"], pdf["text"]):
            for kind, a, b, votes, features in spans(text):
                rows.append((rid, field, turn, key, kind, a, b, votes, features))
        if rows:
            yield pd.DataFrame(rows, columns=["record_id", "field_name", "turn_no", "text_key", "pii_type", "start", "stop", "votes", "features"])


_SPANS = "record_id string, field_name string, turn_no int, text_key long, pii_type string, start int, stop int, votes array<int>, features array<string>"

# Starting points of the expectation-maximisation: share of true spans, and per labeler how often a
# vote agrees with the truth (shape, check, gazetteer, cue before, cue after, code, neighbour).
PRIOR = {"email": 0.9, "phone": 0.7, "id_number": 0.6, "address": 0.8, "name": 0.4}
AGREE = np.array([0.6, 0.85, 0.7, 0.9, 0.9, 0.95, 0.85])
STRENGTH = 50.0  # pseudo-votes behind the starting points


def fit_labelers(votes: np.ndarray, kind: str, rounds: int = 30) -> tuple[float, np.ndarray, np.ndarray]:
    """(share, hit, false): EM for two classes; hit and false are P(vote for | true), P(vote for | not),
    over spans on which the labeler does not abstain. *votes* is rows x labelers in {1, 0, -1}."""
    share, hit, false = PRIOR[kind], AGREE.copy(), 1 - AGREE
    cast = votes >= 0
    yes = votes == 1
    for _ in range(rounds):
        p = posterior(votes, share, hit, false)
        share = (p.sum() + STRENGTH * PRIOR[kind]) / (len(p) + STRENGTH)
        w = p[:, None] * cast
        hit = ((w * yes).sum(0) + STRENGTH * AGREE) / (w.sum(0) + STRENGTH)
        w = (1 - p)[:, None] * cast
        false = ((w * yes).sum(0) + STRENGTH * (1 - AGREE)) / (w.sum(0) + STRENGTH)
        hit, false = np.clip(hit, 0.02, 0.98), np.clip(false, 0.02, 0.98)
        hit = np.maximum(hit, false)  # a labeler is never taken for its opposite
    return share, hit, false


def posterior(votes: np.ndarray, share: float, hit: np.ndarray, false: np.ndarray) -> np.ndarray:
    score = np.log(share / (1 - share)) + ((votes == 1) * np.log(hit / false) + (votes == 0) * np.log((1 - hit) / (1 - false))).sum(1)
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _hash(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % HASHED


def _matrix(features: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    cols = np.fromiter((_hash(x) for f in features for x in f), np.int64, len(rows))
    return rows, cols


def fit_classifier(votes: np.ndarray, features: list[list[str]], soft: np.ndarray, rounds: int = 200, decay: float = 2.0) -> np.ndarray:
    """Weights of a logistic classifier on top of the labelers' log-odds: hashed features and a bias.

    Gradient descent on the cross-entropy with the soft labels; *decay* keeps weights small, so few
    rows leave the decision to the labelers.
    """
    w = np.zeros(HASHED + 1)
    if not len(soft):
        return w
    rows, cols = _matrix(features)
    base = np.log(np.clip(soft, 1e-4, 1 - 1e-4) / np.clip(1 - soft, 1e-4, 1))
    target = soft
    seen = np.bincount(cols, minlength=HASHED) + decay
    for _ in range(rounds):
        # half of the evidence of the labelers: the features must be able to carry a decision
        z = 0.5 * base + w[HASHED] + np.bincount(rows, w[cols], minlength=len(soft))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        w[:HASHED] -= 0.5 * (np.bincount(cols, g[rows], minlength=HASHED) + decay * w[:HASHED] * 0.1) / seen
        w[HASHED] -= 0.1 * g.mean()
    return w


class Model:
    """Labeler reliabilities and classifier weights per type."""

    def __init__(self) -> None:
        self.labelers = {k: (PRIOR[k], AGREE.copy(), 1 - AGREE) for k in TYPES}
        self.weights = {k: np.zeros(HASHED + 1) for k in TYPES}

    def fit(self, kind: str, votes: np.ndarray, features: list[list[str]]) -> None:
        self.labelers[kind] = fit_labelers(votes, kind)
        soft = posterior(votes, *self.labelers[kind])
        self.weights[kind] = fit_classifier(votes, features, soft)

    def score(self, kind: str, votes: np.ndarray, features: list[list[str]]) -> np.ndarray:
        """Probability that a span is personal information."""
        soft = posterior(votes, *self.labelers[kind])
        w = self.weights[kind]
        rows, cols = _matrix(features)
        base = np.log(np.clip(soft, 1e-4, 1 - 1e-4) / np.clip(1 - soft, 1e-4, 1))
        z = (0.5 if w.any() else 1.0) * base + w[HASHED] + np.bincount(rows, w[cols], minlength=len(soft))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _decide(model: Model, limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = np.zeros(len(pdf))
            for kind, part in pdf.groupby("pii_type").groups.items():
                at = pdf.index.get_indexer(part)
                votes = np.stack(pdf["votes"].to_numpy()[at])
                score[at] = model.score(kind, votes, [list(f) for f in pdf["features"].to_numpy()[at]])
            yield pdf.assign(score=score)[score >= limit][["record_id", "field_name", "turn_no", "text_key", "pii_type", "start", "stop", "score"]]

    return run


def fields(df: DataFrame) -> DataFrame:
    """(record_id, field_name, turn_no, text) of all texts of training records."""
    part = lambda name, turn, text: F.struct(F.lit(name).alias("field_name"), turn.cast("int").alias("turn_no"), text.cast("string").alias("text"))
    single = F.array(part("source_prompt", F.lit(-1), F.col("meta.source_prompt")), part("source_response", F.lit(-1), F.col("meta.source_response")))
    turns = F.transform(F.coalesce("messages", F.array()), lambda m, i: part("content", i, m["content"]))
    rows = df.select(F.col("id").cast("string").alias("record_id"), F.explode(F.concat(single, turns)).alias("f"))
    return rows.select("record_id", "f.*").filter("record_id is not null and text is not null and text != ''")


def fit(proposed: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The model fitted on about *rows* proposed spans per type, chosen by hash."""
    model = Model()
    keys = [F.col(c) for c in ("record_id", "field_name", "turn_no", "start")]
    for kind in TYPES:
        got = C.hash_sample(proposed.filter(F.col("pii_type") == kind), keys, rows).select(*keys, "votes", "features").toPandas()
        if len(got):
            got = got.sort_values(["record_id", "field_name", "turn_no", "start"])
            model.fit(kind, np.stack(got["votes"].to_numpy()), [list(f) for f in got["features"]])
    return model


def find(texts: DataFrame, limit: float = 0.5) -> DataFrame:
    """(record_id, field_name, turn_no, text_key, pii_type, start, stop, score) of the spans accepted;
    text_key is a hash of the text they stand in."""
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    proposed = checkpoint(keyed.mapInPandas(_propose, _SPANS))
    model = fit(proposed)
    return proposed.mapInPandas(_decide(model, limit), "record_id string, field_name string, turn_no int, text_key long, pii_type string, start int, stop int, score double")


def cut(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with placeholders; spans that overlap are one, named after the longest of them."""
    merged: list[list] = []  # start, stop, length of the longest, its type
    for a, b, kind in sorted(found):
        if merged and a < merged[-1][1]:
            last = merged[-1]
            last[1] = max(last[1], b)
            if b - a > last[2]:
                last[2:] = [b - a, kind]
        else:
            merged.append([a, b, b - a, kind])
    parts, at = [], 0
    for a, b, _, kind in merged:
        parts += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join(parts) + text[at:]


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(record_id, field_name, turn_no, redacted): texts with typed placeholders, rest as it is. Two
    deliveries of a field with different texts give two rows, each cut by its own spans."""
    keys = ["record_id", "field_name", "turn_no", "text_key"]
    cuts = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("start", "stop", "pii_type"))).alias("cuts"))
    rows = texts.withColumn("text_key", F.xxhash64("text")).dropDuplicates(keys).join(cuts, keys, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [t if c is None else cut(t, [(x["start"], x["stop"], x["pii_type"]) for x in c]) for t, c in zip(pdf["text"], pdf["cuts"])]
            yield pdf[keys[:3]].assign(redacted=out)

    return rows.select(*keys, "text", "cuts").mapInPandas(run, "record_id string, field_name string, turn_no int, redacted string")
