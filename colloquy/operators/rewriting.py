"""Prompts for external models: rewriting (one JSON document per record), pairs, planted errors, judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import text_or_empty
from .pairs import other_scenario

# What each scenario asks of a reply, the system prompt, the form and the demands of the answer.
GUIDE = {
    "物流-查件催发": "用户关心发货、物流轨迹、快递进展、催促配送。回复要给查看轨迹、催促或联系平台核实的路径，不能编造具体到达时间。",
    "物流-配送调整": "用户想改地址、改配送时间、拒收、自提、转寄等。回复要区分出库前后，不能承诺一定能改。",
    "售后-退换维修": "用户咨询退货、换货、维修、保修、取件、寄回。回复要说明订单详情页售后入口、商品状态和凭证要求。",
    "售后-质量异常": "用户反馈破损、错发、漏发、异味、不能用、质量问题。回复要安抚，并要求照片视频等凭证提交售后核实。",
    "退款-取消价保": "用户咨询退款、取消订单、价保、差价、到账。回复要说明申请入口、规则、原支付渠道返回，不承诺具体金额或到账时间。",
    "商品咨询-参数": "用户询问尺寸、材质、型号、容量、保质期、适配范围等。回复要围绕参数和详情页判断点回答。",
    "商品咨询-使用方法": "用户询问安装、连接、清洗、设置、使用步骤。回复要给简洁步骤或排查路径。",
    "购买决策-推荐对比": "用户需要推荐、对比、怎么选。回复要按场景、预算、核心参数给建议。",
    "价格活动-优惠赠品": "用户咨询优惠券、满减、赠品、包邮、活动价。回复要直接说明看结算页/活动规则及处理路径。",
    "发票-资质服务": "用户咨询发票、抬头、税号、资质、客服电话、服务保障。回复要说明订单详情开票或联系平台客服。",
    "投诉-安抚升级": "用户表达不满、投诉、催处理、认为被敷衍。回复要先道歉理解，再给反馈或平台介入路径。",
    "闲聊-礼貌收尾": "用户表达感谢、确认、结束对话。回复要简短礼貌收尾，不要展开复杂流程。",
}
SYSTEM = (
    "你是电商客服 SFT 数据改写专家。你的任务是把真实客服原始对话改写成高质量训练样本。\n"
    "必须遵守：\n"
    "1. 保留用户真实诉求和场景类别，不要把问题改成别的问题。\n"
    "2. 去除具体品牌、具体商品专名、订单号、手机号、地址、姓名等隐私和强实体信息。\n"
    "3. 不要输出方括号占位符，例如 [数字x]、[ORDERID]、[商品信息]；需要数字时改成自然数字或泛化说法。\n"
    "4. 客服回复要直接回答问题，不能只说稍等、帮您查询、请耐心等待。\n"
    "5. 可以说明以订单详情页、活动页、售后页为准，但必须给出可执行路径。\n"
    "6. 不要编造已查询到的订单状态、库存、物流节点、退款金额、具体时效。\n"
    "7. 多轮对话中，如果最后回答依赖历史信息，必须使用历史里的关键信息。\n"
    "8. 回复风格要礼貌、简洁、自然，通常 30-160 个中文字符。\n"
    "9. 场景分类只写在 JSON 的 scenario 字段里，不要写进 assistant content。\n"
    "10. 最后一条 assistant content 只写客服回复正文，不要包含“分类：”或“回复：”前缀。\n"
    "11. 输出必须是严格 JSON，不要 Markdown，不要代码块。"
)
REQUIREMENTS = (
    "messages 必须从用户开始，user/assistant 交替，最后一条必须是 assistant。",
    "可以保留多轮历史，但要更可读；无价值历史可以删减。",
    "最后一条 assistant 只写客服回复正文，不要写“分类：”和“回复：”。",
    "如果 target_scenario 是具体类别，scenario 必须严格等于 target_scenario；如果 target_scenario 要求你选择类别，scenario 必须是 allowed_scenarios 中最合适的一类。",
)
CHOOSE = "请根据原始对话从 allowed_scenarios 中选择一个最合适类别"
BY_NAME = "按类别名称理解客服场景。"


def rewrite_payload(id: Column, scenario: Column, flags: Column, history_required: Column, history: Column, prompt: Column, response: Column, guide: dict[str, str] = GUIDE) -> Column:
    """The user prompt of a record as JSON; a scenario outside *guide* is left to be chosen.

    *history* is an array of [user, assistant] arrays; shorter ones are left out.
    """
    strings = lambda xs: F.array(*map(F.lit, xs))
    name = text_or_empty(scenario)
    known = F.create_map(*[F.lit(x) for kv in guide.items() for x in kv])
    turns = F.filter(F.coalesce(history, F.array().cast("array<array<string>>")), lambda p: F.size(p) >= 2)
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.lit(text).alias("content"))
    payload = F.struct(
        F.lit("rewrite_jddc_customer_service_sample").alias("task"),
        F.when(name.isin(*guide), name).otherwise(F.lit(CHOOSE)).alias("target_scenario"),
        strings(sorted(guide)).alias("allowed_scenarios"),
        F.coalesce(F.try_element_at(known, name), F.lit(BY_NAME)).alias("scenario_definition"),
        F.coalesce(flags, F.array().cast("array<string>")).alias("source_quality_flags"),
        F.coalesce(history_required, F.lit(False)).alias("history_required"),
        F.struct(
            F.transform(turns, lambda p: F.struct(F.get(p, 0).alias("user"), F.get(p, 1).alias("assistant"))).alias("history"),
            text_or_empty(prompt).alias("current_user"),
            text_or_empty(response).alias("current_assistant"),
        ).alias("raw_dialogue"),
        F.struct(
            id.alias("id"),
            F.lit("必须是 allowed_scenarios 中的一个类别").alias("scenario"),
            F.array(said("user", "改写后的用户历史或当前问题"), said("assistant", "改写后的客服历史或最终回答")).alias("messages"),
            F.lit("一句话说明主要改写点，尤其说明是否使用了历史信息").alias("rewrite_notes"),
        ).alias("output_schema"),
        strings(REQUIREMENTS).alias("requirements"),
    )
    return F.to_json(payload, {"pretty": "true", "ignoreNullFields": "false"})


# Labels and demands of the pair, error and judge prompts.
NO_SCENARIO = "电商客服"
WANT_PAIR = "请针对以上客户的提问，生成两条质量有明显差距的客服回复对比。"
ERRORS = {
    "wrong_intent": ("请假装这是'", "'场景的问题来回答，故意答非所问。"),
    "missing_action": "请保留正确回复的信息和方向，但把所有具体操作入口和步骤去掉，只留空洞的建议。",
    "history_ignored": "请只根据用户的最后一句话回答，故意忽略历史对话中的所有关键信息。",
}
SCENARIOS = (
    "物流-查件催发", "物流-配送调整", "退款-取消价保", "售后-退换维修", "售后-质量异常", "发票-资质服务",
    "价格活动-优惠赠品", "商品咨询-使用方法", "商品咨询-参数", "购买决策-推荐对比", "投诉-安抚升级", "闲聊-礼貌收尾",
)
SCORES = (
    "请按以下JSON格式输出评分：",
    "{",
    '  "需求解决": <1-5>,',
    '  "回答准确": <1-5>,',
    '  "有帮助性": <1-5>,',
    '  "语气体验": <1-5>,',
    '  "风险控制": <1-5>,',
    '  "历史利用": <1-5或null(单轮填null)>,',
    '  "通过": <true/false, 需求解决>=4且回答准确>=4为通过>,',
    '  "失败标签": "<不通过时从以下选一个：off_topic/too_generic/missing_action/wrong_intent/overpromise/placeholder_leak/history_ignored/tone_poor/unsafe_policy, 通过时填null>",',
    '  "解释": "<简短解释，50字以内>"',
    "}",
    "",
    "只输出JSON，不要Markdown代码块。",
)


def _said(lines: list[Column]) -> Column:
    """Lines joined; null ones are left out."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def dialogue_so_far(messages: Column) -> Column:
    """All but the last two messages, one line each with the speaker's name; null if there are none."""
    c = F.coalesce(messages, M.none())
    early = F.slice(c, F.lit(1), F.greatest(F.size(c) - 2, F.lit(0)))
    lines = F.transform(early, lambda m: F.concat(F.when(m["role"] == M.USER, "用户：").otherwise("客服："), text_or_empty(m["content"])))
    return F.when(F.size(early) > 0, F.array_join(lines, "\n"))


def pair_prompt(messages: Column, scenario: Column) -> Column:
    """Asks for a good and a bad answer to the last question."""
    past, last = dialogue_so_far(messages), M.last_pair(messages)
    return _said([F.when(past.isNotNull(), F.concat(F.lit("历史对话：\n"), past, F.lit("\n"))), F.concat(F.lit("场景类别："), F.coalesce(scenario, F.lit(NO_SCENARIO))), F.concat(F.lit("客户最后提问："), last["user"], F.lit("\n")), F.lit(WANT_PAIR)])


def error_prompt(messages: Column, scenario: Column, error: Column, *key: Column) -> Column:
    """Asks for an answer with one planted error; another scenario is chosen by the hash of *key*."""
    past, last = dialogue_so_far(messages), M.last_pair(messages)
    name = F.coalesce(scenario, F.lit(NO_SCENARIO))
    before, after = ERRORS["wrong_intent"]
    other = other_scenario(name, F.array(*map(F.lit, SCENARIOS)), *key)
    demand = F.when(error == "wrong_intent", F.concat(F.lit(before), other, F.lit(after)))
    for kind in ("missing_action", "history_ignored"):
        demand = demand.when(error == kind, ERRORS[kind])
    reply = last["assistant"]
    return _said(
        [
            F.concat(F.lit("场景类别："), name),
            F.when((error == "history_ignored") & past.isNotNull(), F.concat(F.lit("\n历史对话：\n"), past)),
            F.concat(F.lit("\n用户最后提问："), last["user"]),
            F.concat(F.lit("原始正确回复（"), F.length(reply).cast("string"), F.lit("字）："), reply, F.lit("\n")),
            demand,
        ]
    )


def judge_prompt(messages: Column, prompt: Column, reply: Column, response: Column, scenario: Column, expected: Column, keywords: Column) -> Column:
    """Asks for the scores of a generated reply against an annotation. The question is the one before last of
    *messages*, or *prompt* where there are fewer than two."""
    past = dialogue_so_far(messages)
    asked = F.when(F.size(F.coalesce(messages, M.none())) >= 2, M.last_pair(messages)["user"]).otherwise(text_or_empty(prompt))
    answer = F.coalesce(F.nullif(text_or_empty(reply), F.lit("")), text_or_empty(response))
    return _said(
        [
            F.concat(F.lit("场景类别："), text_or_empty(scenario)),
            F.concat(F.lit("对话类型："), F.when(past.isNotNull(), "多轮").otherwise("单轮"), F.lit("\n")),
            F.when(past.isNotNull(), F.concat(F.lit("历史对话：\n"), past, F.lit("\n"))),
            F.concat(F.lit("用户最后问题："), asked, F.lit("\n")),
            F.concat(F.lit("AI客服回复："), answer, F.lit("\n")),
            F.concat(F.lit("人工预期标准："), text_or_empty(expected)),
            F.concat(F.lit("关键参考词："), text_or_empty(keywords), F.lit("\n")),
            *map(F.lit, SCORES),
        ]
    )
