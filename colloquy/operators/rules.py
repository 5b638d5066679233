"""Rule packs: ordered ladders, keyword scoring, quality gates.

A pack is data. Ladders become one CASE expression, keyword scoring one fold over an array literal,
so a pack of any size stays a single projection in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import replies as R
from ..functions import text as T

# The intents in their fixed order with their keywords.
INTENTS = {
    "物流-查件催发": ("发货", "发出", "到货", "多久到", "什么时候到", "物流", "快递", "配送", "派送", "运单", "催", "查件", "没更新", "到哪", "揽收"),
    "物流-配送调整": ("改地址", "地址错", "换地址", "改配送", "配送时间", "派送时间", "收货时间", "修改收货", "修改配送", "自提", "驿站", "拒收", "转寄", "拦截快递", "送货上门", "不上门"),
    "售后-退换维修": ("退货", "换货", "维修", "返修", "售后", "保修", "取件", "上门取", "寄回", "七天无理由", "拆封", "退换"),
    "售后-质量异常": ("坏了", "破损", "碎了", "裂", "漏发", "少发", "错发", "质量", "异味", "不能用", "不亮", "没反应", "瑕疵", "划痕"),
    "退款-取消价保": ("退款", "取消", "价保", "差价", "退差", "到账", "原路退", "白条", "审核退款", "退钱", "撤销", "降价"),
    "商品咨询-参数": ("尺寸", "大小", "材质", "型号", "规格", "容量", "保质期", "生产日期", "适配", "颜色", "重量", "参数", "成分", "含量", "正品", "原装", "真假", "授权"),
    "商品咨询-使用方法": ("怎么用", "如何使用", "安装", "连接", "设置", "清洗", "保养", "配对", "充电", "说明书", "操作", "使用方法"),
    "购买决策-推荐对比": ("推荐", "哪个好", "怎么选", "区别", "对比", "适合", "划算", "买哪", "选择", "家用", "老人用", "孩子用"),
    "价格活动-优惠赠品": ("优惠", "优惠券", "满减", "活动", "赠品", "赠送", "包邮", "会员价", "折扣", "促销", "京豆", "价格"),
    "发票-资质服务": ("发票", "开票", "抬头", "税号", "资质", "客服", "电话", "证明", "电子票", "服务", "保障"),
    "投诉-安抚升级": ("投诉", "差评", "生气", "不满意", "赔偿", "补偿", "态度", "欺骗", "太慢", "敷衍", "没人管", "升级"),
    "闲聊-礼貌收尾": ("谢谢", "感谢", "好的", "好吧", "知道了", "没事", "不用了", "再见", "嗯嗯", "可以了"),
}
# First-match rules on the prompt: pattern, label, score.
PRIORITY = (
    (r"退款|退钱|到账|价保|差价|退差|取消订单|订单取消", "退款-取消价保", 100),
    (r"换.{0,8}(尺寸|颜色|型号|尺码)|小一号|大一号", "售后-退换维修", 101),
    (r"退货|换货|返修|维修|保修|售后|上门取件|寄回", "售后-退换维修", 100),
    (r"坏了|破损|碎了|漏发|少发|错发|质量|异味|不能用|不亮|没反应|瑕疵|划痕", "售后-质量异常", 100),
    (r"正品|原装|真假|授权", "商品咨询-参数", 100),
    (r"(改|修改|换).{0,6}(地址|收货|配送|派送|时间|电话|手机号)|拒收|自提|驿站", "物流-配送调整", 99),
)
# Patterns behind the quality flags of a reply.
BOILERPLATE = r"有什么问题我可以帮您处理或解决呢|请问还有其他还可以帮到您的吗|请问您是咨询之前的问题还是有其他的问题需要处理呢|感谢您对京东的支持|请您稍等|马上为您查询|正在查看|您好[，,]?请问有什么可以帮"
OVERPROMISE = r"已为您查询|马上为您查询|正在为您核实|我这边看到|我已经|已记录|一定|务必|立即|马上处理|专员跟进|优先处理|给您申请|帮您申请|仓库会|快递会|财务正在|拦截成功|免费更换|补偿您"
PRIVATE = r"订单号|手机号|收货地址|身份证|银行卡|姓名|电话"
CONFLICT = r"不能退.*可以退|可以退.*不能退|不支持.*支持|支持.*不支持|无法取消.*可以取消|可以取消.*无法取消|没有货.*有货|有货.*没有货"

# Phrases that carry no answer, and words of an answer that does something.
WAITING = r"请您稍等一下，正在为您核实处理中哦|马上核实情况，请您稍等哈|还请您稍等，马上为您查询|小妹为您看看，您稍等哦|请您稍等，小妹正在查询中|请稍等|稍等|正在查看|在查询|我找下哈|我查看下|帮您查看一下|马上为您查询|正在为您查询|还辛苦您再等待"
FILLER = r"您好|亲亲|亲爱的客户|亲爱的|亲|哈|哦|呢|呀|~|～"
ACTION = r"可以|无法|不能|需要|建议|预计|显示|已经|等待|退款|配送|发货|拒收|修改|取消|售后|订单|物流"
PREVIOUS_OR_OTHER = r"请问您是咨询之前的问题还是有其他的问题需要处理呢"


@dataclass(frozen=True)
class Pack:
    """A lexicon in label order, first-match rules, and points for hits in the prompt and elsewhere."""

    lexicon: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(INTENTS))
    priority: tuple[tuple[str, str, int], ...] = PRIORITY
    in_prompt: int = 3
    elsewhere: int = 1
    unknown: str = "unknown"


def ladder(rules: list[tuple[Column, str]]) -> Column:
    """The label of the first rule that holds; null if none does."""
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, label in rules[1:]:
        out = out.when(condition, F.lit(label))
    return out


def classify(prompt: Column, others: Column, pack: Pack = Pack()) -> Column:
    """struct(label, score, scores): priority rules on the prompt, else the best keyword score.

    scores is an array of (label, score) above 0, best first, ties in label order.
    """
    table = F.array(
        *[F.struct(F.lit(n).alias("rank"), F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words")) for n, (label, words) in enumerate(pack.lexicon.items())]
    )
    first = lambda label, score: F.array(F.struct(F.lit(label).alias("label"), F.lit(score).alias("score")))

    def found(x: Column) -> Column:
        own, everything = x["own"], x["everything"]
        points = lambda w: F.when(F.contains(everything, w), F.when(F.contains(own, w), pack.in_prompt).otherwise(pack.elsewhere)).otherwise(0)
        scored = F.transform(table, lambda row: F.struct((-F.aggregate(row["words"], F.lit(0), lambda s, w: s + points(w))).alias("minus"), row["rank"].alias("rank"), row["label"].alias("label")))
        ranked = F.array_sort(F.filter(scored, lambda s: s["minus"] < 0))
        out = F.transform(ranked, lambda s: F.struct(s["label"].alias("label"), (-s["minus"]).alias("score")))
        for pattern, label, score in reversed(pack.priority):
            out = F.when(own.rlike(pattern), first(label, score)).otherwise(out)
        return out

    own = T.text_or_empty(prompt)
    texts = F.struct(own.alias("own"), F.concat_ws(" ", own, T.text_or_empty(others)).alias("everything"))
    return T.bind(
        T.bind(texts, found),
        lambda f: F.struct(
            F.coalesce(F.try_element_at(f, F.lit(1))["label"], F.lit(pack.unknown)).alias("label"),
            F.coalesce(F.try_element_at(f, F.lit(1))["score"], F.lit(0)).alias("score"),
            f.alias("scores"),
        ),
    )


@dataclass(frozen=True)
class Gate:
    """Length limits of the quality gate, in compact characters."""

    min_prompt: int = 2
    hard_min_reply: int = 6
    soft_min_reply: int = 15
    hard_max_reply: int = 600
    soft_max_reply: int = 220


def quality(prompt: Column, response: Column, has_history: Column, label: Column, gate: Gate = Gate()) -> Column:
    """struct(reason, flags): why a row is dropped, and the flags raised before that point.

    There is no flag for a cut history: histories are cut to the permitted turns before a row gets here, so
    it could never be raised.
    """
    keys = F.struct(T.loose_key(prompt).alias("pk"), T.loose_key(response).alias("rk"), label.alias("label"))
    prompt, response = T.text_or_empty(prompt), T.text_or_empty(response)

    def steps(x: Column) -> list[tuple[str | None, str | None, Column]]:
        """(exit reason or None, flag or None, condition) in the order in which they are looked at."""
        p, r = F.length(x["pk"]), F.length(x["rk"])
        return [
            ("empty_prompt_or_response", None, (prompt == "") | (response == "")),
            (None, "unknown_intent", x["label"] == "unknown"),
            ("too_short_prompt", None, p < gate.min_prompt),
            ("too_short_reply_hard", None, r < gate.hard_min_reply),
            (None, "short_reply_rewrite", r < gate.soft_min_reply),
            ("too_long_reply_hard", None, r > gate.hard_max_reply),
            (None, "long_reply_rewrite", r > gate.soft_max_reply),
            (None, "placeholder_rewrite", prompt.rlike(T.PLACEHOLDER) | response.rlike(T.PLACEHOLDER)),
            (None, "long_digit_rewrite", prompt.rlike(T.LONG_DIGITS) | response.rlike(T.LONG_DIGITS)),
            (None, "boilerplate_rewrite", response.rlike(BOILERPLATE)),
            (None, "overpromise_rewrite", response.rlike(OVERPROMISE)),
            (None, "privacy_or_private_info_rewrite", response.rlike(PRIVATE)),
            (None, "possible_conflict_rewrite", x["rk"].rlike(CONFLICT)),
            (None, "stutter_rewrite", T.key_stutters(x["pk"]) | T.key_stutters(x["rk"])),
            (None, "has_history", has_history),
        ]

    def gated(x: Column) -> Column:
        # the place of the exit is found once; a flag counts if it stands before that place
        looked = steps(x)
        place = F.lit(len(looked))
        for n in range(len(looked) - 1, -1, -1):
            if looked[n][0]:
                place = F.when(looked[n][2], F.lit(n)).otherwise(place)

        def at(e: Column) -> Column:
            reason = ladder([(e == n, name) for n, (name, _, _) in enumerate(looked) if name])
            flags = F.array(*[F.when((e > n) & condition, F.lit(flag)) for n, (_, flag, condition) in enumerate(looked) if flag])
            return F.struct(reason.alias("reason"), F.array_compact(flags).alias("flags"))

        return T.bind(place, at)

    return T.bind(keys, gated)


def record_fault(label: Column, messages: Column, domain: list[str]) -> Column:
    """Why a rewritten record is rejected; null if it is accepted: label, types, roles and contents, an empty
    final reply, leaks in any message. The final reply is cleaned before it is looked at."""
    name = T.strip(T.text_or_empty(label))
    outside = ~name.isin(*domain)
    fault = M.role_fault(messages)
    size = F.size(messages)
    final = R.clean_reply(F.try_element_at(messages, F.lit(-1))["content"])

    def judged(x: Column) -> Column:
        earlier = F.transform(F.slice(messages, 1, F.greatest(size - 1, F.lit(0))), lambda m: T.strip(T.text_or_empty(m["content"])))
        text = F.array_join(F.concat(earlier, F.array(x)), "\n")
        leaks = T.bind(text, lambda t: F.when(t.rlike(T.PLACEHOLDER), "placeholder_leak").when(t.rlike(T.LONG_DIGITS), "long_digit_leak"))
        return F.when(outside, F.concat(F.lit("invalid_scenario:"), name)).when(fault.isNotNull(), fault).when(x == "", "empty_final_reply").otherwise(leaks)

    return T.bind(F.coalesce(final, F.lit("")), judged)


def substantive(response: Column, least: int = 18) -> Column:
    """Whether a reply without its filler still has *least* compact characters and a word of action."""
    out = T.text_or_empty(response)
    for pattern in (PREVIOUS_OR_OTHER, WAITING, BOILERPLATE, FILLER):
        out = F.regexp_replace(out, pattern, "")
    return T.bind(out, lambda x: (T.compact_length(x) >= least) & x.rlike(ACTION))


# What a flag costs a candidate.
PENALTIES = {
    "placeholder_rewrite": 0.8,
    "boilerplate_rewrite": 1.3,
    "short_reply_rewrite": 1.1,
    "long_digit_rewrite": 0.8,
    "privacy_or_private_info_rewrite": 1.0,
    "overpromise_rewrite": 1.2,
    "stutter_rewrite": 1.5,
    "long_reply_rewrite": 1.0,
    "possible_conflict_rewrite": 1.5,
}


def candidate_score(prompt_length: Column, reply_length: Column, has_history: Column, flags: Column, unknown: float = 1.0) -> Column:
    """Points for fitting lengths and for history, less the penalties of the flags."""
    costs = F.create_map(*[F.lit(x) for kv in {**PENALTIES, "unknown_intent": unknown}.items() for x in kv])
    lost = F.aggregate(F.array_distinct(F.coalesce(flags, F.array().cast("array<string>"))), F.lit(0.0), lambda s, f: s + F.coalesce(F.try_element_at(costs, f), F.lit(0.0)))
    return (
        F.when(prompt_length.between(6, 80), 3.0).otherwise(0.0)
        + F.when(reply_length.between(18, 180), 4.0).otherwise(0.0)
        + F.when(F.coalesce(has_history, F.lit(False)), 1.0).otherwise(0.0)
        - lost
    )
