"""Keyword profiles: the words and patterns by which offers are found, read and judged.

A profile is a parameter of every operator that uses one, since other corpora
need other words. OFFERS is the one for the Chinese and English pages of AI vendors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Signals of the block score.
STRONG = (
    "赠送", "送", "免费", "白嫖", "试用", "体验金", "赠金", "额度", "token", "Token", "TOKEN", "免费额度", "新用户", "注册即送", "学生", "校园",
    "优惠", "折扣", "半价", "限时", "领取", "free", "credit", "credits", "trial", "student", "free tier", "giveaway",
)
WEAK = ("活动", "福利", "补贴", "返现", "兑换", "礼包", "计划", "promotion", "offer", "deal")
NEGATIVE = ("招聘", "岗位", "实习", "隐私政策", "服务条款", "cookie", "登录", "注册账号", "价格对比", "企业版咨询", "联系我们", "版权所有")
GIFT_WORDS = ("赠送", "送出", "送", "免费", "白嫖", "赠金", "体验金", "代金券", "免费额度", "注册即送", "领取", "领取额度", "free credit", "free tier", "giveaway", "credits for free")

# Categories and audiences in order of priority.
CATEGORIES = (
    ("student", ("学生", "校园", "在校", "学信网", "edu 邮箱", "edu邮箱", ".edu", "教育优惠", "student", "education")),
    ("trial", ("试用", "体验", "免费试用", "trial", "free trial", "pilot")),
    ("discount", ("折扣", "半价", "优惠价", "打折", "促销", "discount", "off ", "coupon", "立减")),
    ("free_credit", ("赠送", "送", "白嫖", "免费额度", "赠金", "体验金", "代金券", "免费", "发放", "领取", "credit", "free", "giveaway")),
    ("refreshable", ("每日", "每月", "每周", "周期性", "刷新", "重置", "daily", "monthly", "weekly", "renew")),
)
AUDIENCES = (
    ("new_user", ("新用户", "首次注册", "新注册", "新客", "首次登录", "注册即送", "new user", "new account", "sign up")),
    ("student", ("学生", "校园", "在校", "学信网", "edu 邮箱", "edu邮箱", ".edu", "student")),
    ("teacher", ("教师", "老师", "教职工", "teacher", "educator", "faculty")),
    ("open_source", ("开源", "维护者", "maintainer", "open source")),
    ("startup", ("初创", "创业", "创业公司", "startup")),
    ("enterprise", ("企业", "团队版", "enterprise", "business")),
    ("verified", ("实名", "实名认证", "实名制", "绑卡", "verification", "verify")),
)
CARD = ("信用卡", "绑卡", "需要银行卡", "credit card", "visa", "mastercard", "需绑定支付")
NO_CARD = ("无需绑卡", "不用绑卡", "无需信用卡", "no credit card", "without credit card")
RECURRING = (("daily", ("每日", "每天", "daily", "every day")), ("weekly", ("每周", "weekly")), ("monthly", ("每月", "monthly")))
GIFT_SIGNALS = (
    "赠送", "送出", "免费", "白嫖", "赠金", "体验金", "代金券", "免费额度", "免费试用", "注册即送", "领取", "新用户", "试用", "体验", "福利",
    "零成本", "不限量", "无限", "free", "credit", "trial", "giveaway", "no cost", "complimentary", "bonus",
)

# Titles that say nothing by themselves.
GENERIC_EN = (
    "offer", "offers", "free", "free tier", "free trial", "free plan", "pricing", "plans", "credits", "credit", "promo", "promotion",
    "sign up", "signup", "get started", "learn more", "bonus",
)
GENERIC_ZH = (
    "免费额度", "免费试用", "免费套餐", "新用户免费额度", "新用户专享", "赠送额度", "活动详情", "优惠活动", "领取", "立即领取", "免费领取",
    "福利", "试用", "体验", "套餐", "价格", "定价",
)
NAV_TITLES = (
    "平台操作", "模型服务", "应用开发", "组件广场", "系统管理", "控制台", "文档", "产品", "价格", "定价", "登录", "注册", "首页", "更多", "查看详情",
    "立即购买", "立即开通", "了解详情", "服务条款", "隐私政策", "联系我们", "全部", "其他", "概览", "简介", "快速开始", "操作指南", "使用说明",
    "平台说明", "产品简介", "购买指南", "计费说明", "注意事项",
)

# Patterns of prices, money and clauses.
PRICE_UNIT = r"(?iU)(?:per\s+\d|/\s*\d*\s*(?:1M|1K|M|K|千|万|百万)\s*(?:tokens?|字符|图片|次|calls?))"
PRICE_DENSE = r"(?iU)(?:\$\s*[\d.]+\s*/\s*|¥\s*[\d.]+\s*/|per\s+\d+\s*(?:million|1M|1K|千|万))"
PRICE_CN = (
    r"(?iU)\d[\d,.]*\s*(?:美元|元|美金|美分)\s*/\s*\d[\d,.]*\s*(?:万|千|百)?\s*个?\s*(?:tokens?|字符|图片|次|条|小时)"
    r"|每\s*[\d,.]+\s*(?:万|千)?\s*(?:次|个|条|tokens?)[^。；\n]{0,12}?\d[\d,.]*\s*(?:美元|元|美金)"
    r"|(?:之前为|起为|起调整为|生效\s*为)\s*\d[\d,.]*\s*(?:美元|元|美金)|超出[^。；\n]{0,20}?计费"
)
MONEY = r"(?U)(?:\d[\d,.]*\s*(?:美元|元|美金|美分))|(?:\$\s*\d[\d,.]*)|(?:¥\s*\d[\d,.]*)"
STRONG_GIFT = r"赠送|送出|注册即送|免费领取|赠金|体验金|代金券|免费额度|免费试用|giveaway|free credit"
UNIT_GIFT = r"赠送|送出|注册即送|免费领取|领取|赠金|体验金|代金券|giveaway|free credit"
PAID_TIER = r"(?U)^(?:付费|收费|计费|标准价|原价|按量|超量|超额|超出|基础版|专业版|企业版|旗舰版)\s*(?:层级|档位|套餐|版本|方案|价格)?"
TIER_PRICE = r"(?iU)(?:美元|元|美金)\s*/|per\s+\d|/\s*\d*\s*(?:万|千|个)?\s*(?:tokens?|次|个)"
CLAUSE = r"有效期|资源包|共享消耗|过期作废|不结转|不可转让|依次递减"
CONFIDENT_GIFT = r"(?i)赠送|送出|赠金|体验金|代金券|免费额度|免费试用|注册即送|即送|白嫖|免费领取|free credit|credits|free tier|trial|giveaway"
PROMOTE_GIFT = r"赠送|送出|赠金|体验金|代金券|免费额度|免费试用|注册即送|白嫖|免费领取|即送|可领|领取"
PROMOTE_AMOUNT = r"(?U)\d[\d,.]*\s*(?:亿|万|千|百|k|K|M)?\s*(?:个)?\s*(?:tokens?|Token|TOKEN|元|美元|次|条|字符)|\d+\s*折"
PROMOTE_WHO = r"新用户|注册|首次|学生|认证"

_MODEL = r"[A-Za-z0-9][A-Za-z0-9.\-_/]{0,30}(?:\s+[A-Za-z0-9][A-Za-z0-9.\-_/]{0,30}){0,2}\s*"
#: (pattern, kind, unit, whether group 2 is a factor), the first that matches with an amount over 0 wins.
BENEFITS = (
    (rf"(?U)(\d+(?:\.\d+)?)\s*(亿|万|千|k|K|m|M|b|B)?\s*(?:个)?\s*(?:{_MODEL})?(?:token|tokens|Token|TOKEN|词元)", "token", "token", True),
    (r"(?U)(?:¥|￥|RMB\s*)\s*(\d+(?:\.\d+)?)\s*(亿|万|千)?", "credit_cny", "CNY", True),
    (r"(?U)(\d+(?:\.\d+)?)\s*(亿|万|千)?\s*(?:元|块钱|人民币)", "credit_cny", "CNY", True),
    (r"(?U)\$\s*(\d+(?:\.\d+)?)\s*(k|K|m|M|b|B)?", "credit_usd", "USD", True),
    (r"(?iU)(\d+(?:\.\d+)?)\s*(k|m|b)?\s*(?:美元|美金|USD)", "credit_usd", "USD", True),
    (r"(?U)(\d+)\s*(?:天|日)\s*(?:免费|试用|体验)", "duration", "day", False),
    (r"(?U)(\d+)\s*个?\s*月\s*(?:免费|试用|体验)", "duration", "month", False),
    (r"(?U)(?:赠送|送出|赠|送)\s*(\d+(?:\.\d+)?)\s*(亿|万|千)?\s*(?:个|张|次|条|份|名|位|台|套)?\s*([^\s，。；、,;!?！？]{2,12})", "count", "count", True),
)


@dataclass(frozen=True)
class Profile:
    """Everything that depends on the corpus' language and subject."""

    strong: tuple[str, ...] = STRONG
    weak: tuple[str, ...] = WEAK
    negative: tuple[str, ...] = NEGATIVE
    gift_words: tuple[str, ...] = GIFT_WORDS
    gift_signals: tuple[str, ...] = GIFT_SIGNALS
    categories: tuple = CATEGORIES
    audiences: tuple = AUDIENCES
    card: tuple[str, ...] = CARD
    no_card: tuple[str, ...] = NO_CARD
    recurring: tuple = RECURRING
    benefits: tuple = BENEFITS
    default_category: str = "free_credit"
    labels: dict[str, str] = field(default_factory=dict)


OFFERS = Profile()
