"""Word lists, lookup tables, templates and message texts.

Everything in this module is data whose content must stay exactly as it is for
answers to come out right.  Order matters wherever a list is ordered: ties and
"first match" are decided by it.
"""

# --- fixed values: text used for anything that is missing -------------------
MISSING = "暂无信息"

# --- fixed values: city -> province ----------------------------------------
CITY_PROVINCE = {
    "上海": "上海",
    "银川": "宁夏",
    "海口": "海南",
    "固原": "宁夏",
    "呼和浩特": "内蒙古",
    "景德镇": "江西",
}

# --- fixed values: columns of a raw city export ----------------------------
RAW_COLUMNS = [
    "名字", "地址", "评分", "门票", "开放时间", "建议游玩时间", "介绍", "小贴士",
]

# --- fixed values: names to repair, and the one city they are repaired in ---
REPAIR_CITY = "银川"
REPAIR_NAMES = {
    "Xixia Imperial Tombs": "西夏王陵",
    "Zhengbeibao Western Film Studio": "镇北堡西部影视城",
    "Helan Mountain Rock Art": "贺兰山岩画",
    "Ningxia Museum": "宁夏博物馆",
    "Yinchuan Mingcui Lake National Wetland Park": "鸣翠湖国家湿地公园",
    "Haibao Pagoda": "海宝塔",
    "Suyukou National Forest Park": "贺兰山苏峪口国家森林公园",
}

# --- fixed values: keyword -> tags, in rule order ---------------------------
TAG_RULES = {
    "博物馆": ["博物馆", "历史"],
    "古镇": ["古镇", "历史"],
    "海滩": ["海滩", "休闲"],
    "公园": ["公园", "自然"],
    "寺": ["寺庙", "宗教"],
    "塔": ["古迹", "历史"],
    "山": ["山岳", "自然"],
    "湖": ["湖泊", "自然"],
    "森林": ["森林", "自然"],
    "动物": ["动物园", "亲子"],
    "水族": ["水族馆", "亲子"],
    "影视": ["影视", "娱乐"],
    "老街": ["老街", "历史"],
    "陶瓷": ["陶瓷", "文化"],
    "遗址": ["遗址", "历史"],
    "夜景": ["夜景"],
    "建筑": ["建筑"],
    "迪士尼": ["主题乐园", "亲子"],
    "游乐": ["游乐场", "娱乐"],
    "漂流": ["漂流", "户外"],
    "温泉": ["温泉", "休闲"],
    "电影": ["电影", "娱乐"],
    "草原": ["草原", "自然"],
    "峡谷": ["峡谷", "自然"],
    "瀑布": ["瀑布", "自然"],
    "石窟": ["石窟", "历史"],
    "长城": ["长城", "历史"],
}
MAX_TAGS = 5

# --- fixed values: intent -> keywords, in priority order --------------------
UNKNOWN_INTENT = "UNKNOWN"
MIN_INTENT_CONFIDENCE = 0.05
INTENT_KEYWORDS = {
    "ASK_TICKET": [
        "门票", "票价", "多少钱", "收费", "免费", "价格",
        "费用", "票", "入场费", "入园费", "需要花多少",
    ],
    "ASK_OPEN_TIME": [
        "开放时间", "营业时间", "几点开门", "几点关门", "开门时间",
        "关门时间", "什么时候开", "什么时候关", "开到几点", "几点开始",
        "几点结束", "开放", "营业", "运营时间",
    ],
    "ASK_INTRO": [
        "介绍", "简介", "是什么", "什么样", "怎么样", "好玩吗",
        "有什么", "特色", "亮点", "描述", "概况", "情况",
        "讲讲", "说说", "告诉我", "了解",
    ],
    "ASK_ADDRESS": [
        "地址", "在哪", "在哪里", "位置", "怎么去", "哪里",
        "坐落", "位于", "地点", "所在地",
    ],
    "ASK_PHONE": [
        "电话", "联系方式", "联系电话", "手机", "号码",
        "打电话", "咨询电话", "客服电话", "热线",
    ],
    "ASK_WEBSITE": [
        "官网", "网站", "网址", "官方网站", "主页", "网页",
    ],
    "ASK_RATING": [
        "评分", "评价", "口碑", "好不好", "怎么样", "评级",
        "星级", "分数", "打分", "推荐指数",
    ],
    "ASK_SUGGEST_TIME": [
        "玩多久", "游玩时间", "需要多长时间", "多久能玩完",
        "建议时间", "推荐时间", "游览时间", "参观时间",
        "待多久", "花多长时间",
    ],
    "ASK_TAGS": [
        "标签", "类型", "分类", "属于什么", "什么类型",
        "主题", "风格", "特点",
    ],
    "ASK_TIPS": [
        "贴士", "小贴士", "注意事项", "注意", "提醒", "建议",
        "攻略", "技巧", "经验", "须知", "提示", "要注意什么",
    ],
    "ASK_LOCATION": [
        "哪个城市", "什么城市", "哪个省", "什么省",
        "属于哪里", "归属", "所在城市", "所在省份",
    ],
    "ASK_RECOMMEND": [
        "推荐", "有什么好玩的", "值得去吗", "好玩的地方",
        "旅游景点", "去哪玩", "哪里好玩",
    ],
}

# --- fixed values: intent -> description ------------------------------------
UNKNOWN_DESCRIPTION = "未知意图"
INTENT_DESCRIPTIONS = {
    "ASK_TICKET": "询问门票价格",
    "ASK_OPEN_TIME": "询问开放时间",
    "ASK_INTRO": "询问景点简介",
    "ASK_ADDRESS": "询问地址位置",
    "ASK_PHONE": "询问联系电话",
    "ASK_WEBSITE": "询问官方网站",
    "ASK_RATING": "询问评分评价",
    "ASK_SUGGEST_TIME": "询问建议游玩时间",
    "ASK_TAGS": "询问景点标签/类型",
    "ASK_TIPS": "询问游玩贴士",
    "ASK_LOCATION": "询问所在城市/省份",
    "ASK_RECOMMEND": "景点推荐",
}

# --- fixed values: intent -> fields a rule answer needs ---------------------
DEFAULT_SLOTS = ["name", "description"]
INTENT_SLOTS = {
    "ASK_TICKET": ["name", "ticket_price"],
    "ASK_OPEN_TIME": ["name", "open_time"],
    "ASK_INTRO": ["name", "description"],
    "ASK_ADDRESS": ["name", "address", "city", "province"],
    "ASK_PHONE": ["name", "phone"],
    "ASK_WEBSITE": ["name", "website"],
    "ASK_RATING": ["name", "rating"],
    "ASK_SUGGEST_TIME": ["name", "suggest_time"],
    "ASK_TAGS": ["name", "tags"],
    "ASK_TIPS": ["name", "tips"],
    "ASK_LOCATION": ["name", "city", "province"],
    "ASK_RECOMMEND": ["name", "rating", "description", "tags"],
    "UNKNOWN": ["name", "description"],
}

# --- fixed values: answer templates of the rule method ----------------------
RULE_TEMPLATES = {
    "ASK_TICKET": "【{name}】的门票价格为：{ticket_price}",
    "ASK_OPEN_TIME": "【{name}】的开放时间为：{open_time}",
    "ASK_INTRO": "【{name}】景点简介：\n{description}",
    "ASK_ADDRESS": "【{name}】的地址信息：\n省份：{province}\n城市：{city}\n详细地址：{address}",
    "ASK_PHONE": "【{name}】的联系电话为：{phone}",
    "ASK_WEBSITE": "【{name}】的官方网站为：{website}",
    "ASK_RATING": "【{name}】的用户评分为：{rating} 分（满分5分）",
    "ASK_SUGGEST_TIME": "【{name}】的建议游玩时间为：{suggest_time}",
    "ASK_TAGS": "【{name}】的景点标签：{tags}",
    "ASK_TIPS": "【{name}】的游玩贴士：\n{tips}",
    "ASK_LOCATION": "【{name}】位于{province}{city}",
    "ASK_RECOMMEND": "为您推荐【{name}】（评分：{rating}）\n标签：{tags}\n简介：{description}",
    "UNKNOWN": "关于【{name}】，这里是它的基本介绍：\n{description}",
}
RULE_DEFAULT_TEMPLATE = RULE_TEMPLATES["UNKNOWN"]

# --- fixed values: what the classification method words differently ---------
CLASSIFIER_TEMPLATES = {
    **{k: v for k, v in RULE_TEMPLATES.items() if k != UNKNOWN_INTENT},
    "ASK_RATING": "【{name}】的用户评分为：{rating} 分",
}
CLASSIFIER_DEFAULT_TEMPLATE = "关于【{name}】：{description}"

# --- fixed values: messages -------------------------------------------------
FIELD_APOLOGY = "关于【{name}】：暂时无法获取您询问的具体信息。"
CITY_HEADER = "为您推荐{city}的热门景点：\n"
CITY_LINE = "{rank}. 【{name}】- 评分：{rating}"
CITY_MATCH_LABEL = "城市推荐"
RULE_HELP = (
    "抱歉，请在问题中提供具体的景点名称或城市名称，以便我为您查询相关信息。\n\n"
    "您可以这样问：\n"
    "- 上海迪士尼的门票多少钱？\n"
    "- 外滩的开放时间是什么时候？\n"
    "- 给我介绍一下豫园\n"
    "- 上海有什么好玩的景点？"
)
CLASSIFIER_HELP = (
    "抱歉，我没有识别到您询问的具体景点。\n\n"
    "您可以这样问：\n"
    "- 上海迪士尼的门票多少钱？\n"
    "- 外滩什么时候开放？\n"
    "- 介绍一下东方明珠\n"
    "- 上海有什么好玩的景点？"
)
NO_HIT_ANSWER = "抱歉，未找到与您问题相关的景点信息。请尝试更换关键词或询问其他景点。"

# --- fixed values: document template, field -> label ------------------------
DOCUMENT_LABELS = {
    "name": "景点名称",
    "city": "所在城市",
    "province": "所在省份",
    "address": "详细地址",
    "phone": "联系电话",
    "website": "官方网站",
    "rating": "用户评分",
    "ticket_price": "门票价格",
    "open_time": "开放时间",
    "suggest_time": "建议游玩时间",
    "tags": "景点标签",
    "description": "景点简介",
    "tips": "游玩贴士",
}

# --- fixed values: question keyword -> document label, first match wins -----
ANSWER_LABEL_RULES = {
    "门票": "门票价格",
    "票价": "门票价格",
    "多少钱": "门票价格",
    "开放时间": "开放时间",
    "几点": "开放时间",
    "营业": "开放时间",
    "地址": "详细地址",
    "在哪": "详细地址",
    "位置": "详细地址",
    "电话": "联系电话",
    "联系": "联系电话",
    "网站": "官方网站",
    "官网": "官方网站",
    "评分": "用户评分",
    "评价": "用户评分",
    "玩多久": "建议游玩时间",
    "游玩时间": "建议游玩时间",
    "标签": "景点标签",
    "类型": "景点标签",
    "介绍": "景点简介",
    "简介": "景点简介",
    "贴士": "游玩贴士",
    "注意": "游玩贴士",
    "建议": "游玩贴士",
}
SUMMARY_LABEL = "景点简介"
SUMMARY_LENGTH = 300
FIELD_ANSWER = "【{name}】的{label}：{value}"
FIELD_ANSWER_MISSING = "抱歉，关于【{name}】的{label}，目前暂无相关信息。"
SUMMARY_ANSWER = "关于【{name}】：\n{value}"
GENERIC_ANSWER = (
    "已找到【{name}】的相关信息，但未能准确理解您的问题。"
    "您可以尝试询问该景点的门票、开放时间、地址等具体信息。"
)

# --- fixed values: prompt texts ---------------------------------------------
SYSTEM_PROMPT = """你是一个专业的旅游景点智能问答助手。你的任务是根据提供的景点信息文档，准确、友好地回答用户的问题。

重要规则：
1. 只能根据提供的文档内容回答问题，不要编造或推测任何信息
2. 如果文档中没有相关信息，请诚实地告诉用户"根据现有资料，暂无相关信息"
3. 回答要简洁明了，突出关键信息
4. 使用友好、专业的语气
5. 如果用户问的是多个景点，请分别回答"""
USER_PROMPT = """请根据以下景点信息文档，回答用户的问题。

【参考文档】
{documents}

【用户问题】
{question}

请基于以上文档信息回答用户的问题："""
PROMPT_DOCUMENT = "---文档{rank}: {name}---\n{content}"

# --- fixed values: parts of an answer that mean generation failed -----------
FAILURE_MARKERS = ["出错", "失败", "无法连接"]

# --- fixed values: entity boost weights and score fusion --------------------
BOOST_CITY = 0.5
BOOST_PROVINCE = 0.3
BOOST_NAME = 0.8
BOOST_NAME_PART = 0.6
FUSE_COSINE = 0.3
FUSE_BOOST = 0.7

# --- fixed values: cells a CSV reader takes for a missing value -------------
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
