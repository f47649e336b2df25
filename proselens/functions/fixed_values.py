"""Fixed values that results depend on."""

# Emotion words with class and intensity.
EMOTIONS = {
    "狂喜": ("positive", 1.0), "兴奋": ("positive", 0.9), "激动": ("positive", 0.9), "欢呼": ("positive", 0.9), "惊喜": ("positive", 0.8),
    "欣慰": ("positive", 0.7), "满足": ("positive", 0.6), "幸福": ("positive", 0.8), "温暖": ("positive", 0.6), "甜蜜": ("positive", 0.7),
    "愉快": ("positive", 0.7), "开心": ("positive", 0.7), "高兴": ("positive", 0.7), "喜悦": ("positive", 0.8), "得意": ("positive", 0.6),
    "骄傲": ("positive", 0.6), "自豪": ("positive", 0.7), "安心": ("positive", 0.5), "放松": ("positive", 0.4), "宁静": ("positive", 0.3),
    "感动": ("positive", 0.7), "感激": ("positive", 0.6), "期待": ("positive", 0.5), "愤怒": ("negative", 0.9), "暴怒": ("negative", 1.0),
    "狂怒": ("negative", 1.0), "恐惧": ("negative", 0.9), "惊恐": ("negative", 1.0), "绝望": ("negative", 1.0), "悲痛": ("negative", 0.9),
    "悲伤": ("negative", 0.7), "痛苦": ("negative", 0.8), "崩溃": ("negative", 0.9), "撕心裂肺": ("negative", 1.0), "焦虑": ("negative", 0.7),
    "不安": ("negative", 0.6), "紧张": ("negative", 0.7), "害怕": ("negative", 0.7), "惊慌": ("negative", 0.8), "后悔": ("negative", 0.6),
    "愧疚": ("negative", 0.6), "自责": ("negative", 0.6), "怨恨": ("negative", 0.7), "憎恨": ("negative", 0.9), "厌恶": ("negative", 0.7),
    "失落": ("negative", 0.6), "寂寞": ("negative", 0.5), "孤独": ("negative", 0.5), "委屈": ("negative", 0.6), "伤心": ("negative", 0.6),
    "难过": ("negative", 0.5), "危险": ("tension", 0.8), "危机": ("tension", 0.9), "绝境": ("tension", 0.9), "杀意": ("tension", 0.9),
    "杀气": ("tension", 0.8), "对峙": ("tension", 0.8), "冲突": ("tension", 0.7), "决斗": ("tension", 0.9), "战斗": ("tension", 0.8),
    "追杀": ("tension", 0.9), "逃命": ("tension", 0.8), "生死": ("tension", 0.9), "威胁": ("tension", 0.7), "压迫": ("tension", 0.7),
    "窒息": ("tension", 0.8), "悬念": ("tension", 0.6), "疑云": ("tension", 0.6), "阴谋": ("tension", 0.7), "平静": ("neutral", 0.2),
    "淡然": ("neutral", 0.2), "从容": ("neutral", 0.3), "深沉": ("neutral", 0.4), "沉思": ("neutral", 0.3), "沉默": ("neutral", 0.3),
    "思索": ("neutral", 0.2), "观察": ("neutral", 0.1), "观望": ("neutral", 0.1), "徘徊": ("neutral", 0.2), "犹豫": ("neutral", 0.3),
}

# Shapes of an emotion curve at eight points.
ARCS = {
    "rags_to_riches": [0.2, 0.3, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9],
    "riches_to_rags": [0.9, 0.8, 0.7, 0.6, 0.4, 0.3, 0.3, 0.2],
    "man_in_hole": [0.6, 0.5, 0.3, 0.2, 0.3, 0.5, 0.7, 0.8],
    "icarus": [0.4, 0.5, 0.7, 0.9, 0.6, 0.4, 0.3, 0.2],
    "cinderella": [0.3, 0.5, 0.7, 0.4, 0.2, 0.5, 0.7, 0.9],
    "oedipus": [0.7, 0.5, 0.3, 0.5, 0.7, 0.4, 0.3, 0.2],
}

# Sentence templates.
STRUCTURES = {
    "first_second_last": "(?:首先|第一|其一).{3,}?(?:其次|第二|其二).{3,}?(?:再次|第三|其三|最后)",
    "total_sub_total": ".{8,}?[：:].{15,}?(?:总之|综上|总而言之|由此可见)",
    "not_only_but_also": "不仅.{2,}?而且",
    "not_x_but_y": "不是.{2,}?而是",
    "on_one_hand": "一方面.{3,}?另一方面",
    "although_but": "(?:虽然|尽管).{2,}?(?:但是|然而|却)",
    "because_so": "因为.{2,}?所以",
    "moreover": "(?:此外|另外|除此之外).{3,}?(?:也|还|更)",
    "in_short": "(?:总而言之|综上所述|简而言之|一言以蔽之)",
}

# Words that are overused above two in a thousand characters.
OVERUSED = ["就", "都", "很", "非常", "一直", "总是", "已经", "立刻", "马上", "忽然", "突然", "渐渐", "慢慢", "轻轻", "默默", "淡淡", "微微", "略略", "然而", "但是", "不过", "而且", "因此", "所以", "于是", "然后", "接着", "吧", "呢", "啊", "哦", "嗯", "嘛", "啦", "似乎", "仿佛", "好像", "也许", "大概", "可能", "应该", "竟然", "居然"]

# What is said of overused words.
OVERUSED_SAID = [("高频词: ", "。建议替换或删减部分。"), "可尝试变换句式，避免重复使用相同副词开头。"]

# Glad and sad characters, punctuation marks and stop words.
GLAD = ["好", "美", "乐", "喜", "爱", "笑", "暖", "甜", "幸", "赞"]
SAD = ["悲", "痛", "恨", "怒", "哭", "冷", "暗", "苦", "惨", "死"]
MARKS = "，。！？、；：\"'"
STOP = "的了吗呢吧啊嗯哦嘛啦着呢这和那但也却就都还很在一个从到对为被把让给向以"

# Weasel words and hedges, and the patterns among them.
WEASEL = ["众所周知", "不言而喻", "值得注意的是", "显而易见", "毫无疑问", "毋庸置疑", "不可否认", "必须承认", "综上所述", "总而言之"]
HEDGE = ["某种程度上", "某种意义上", "相对而言", "在某种程度上", "在很大程度上", "大体上", "似乎", "仿佛", "好像", "也许", "可能", "大概"]
WEASEL_PATTERNS = [("weasel", "总的来说"), ("hedge", "一般来说"), ("cliche_structure", "令人[一-鿿]{1,3}"), ("cliche_structure", "让人[一-鿿]{1,3}"), ("cliche_structure", "使人[一-鿿]{1,3}"), ("cliche_structure", "[一-鿿]{1,2}地说"), ("cliche_structure", "[一-鿿]{1,2}地道")]

# Classes of description and the verbs of action.
DESCRIPTION = ["(?:红|橙|黄|绿|青|蓝|紫|黑|白|灰|金|银)", "(?:大|小|高|矮|长|短|粗|细|宽|窄)", "(?:形容|仿佛|如同|好像|宛如|宛若|似的|一般)", "(?:声音|气味|味道|触感|温度|光线|阴影)"]
ACTION = "走跑跳飞冲退进出站坐躺跪爬翻转挥打踢推拉抓握抱扔砸砍刺射拔抽拍敲点按捏撕扯咬吞咽"

# Time markers, in order of precedence at one place.
TIMES = [
    (r"(\d+)天后", "days_later"), (r"(\d+)年前", "years_ago"), (r"(\d+)月后", "months_later"), (r"(\d+)个?时辰后", "hours_later"), (r"第(\d+)天", "day_n"),
    (r"第(\d+)日", "day_n"), ("次日", "next_day"), ("翌日", "next_day"), ("当天", "same_day"), ("当日", "same_day"),
    ("一炷香后", "moment_later"), ("一盏茶后", "moment_later"), ("半日后", "half_day"), ("三日后", "three_days"), ("七日后", "seven_days"),
    ("一个月后", "month_later"), ("一年后", "year_later"), ("转眼间", "time_skip"), ("光阴似箭", "time_skip_long"), ("日月如梭", "time_skip_long"),
    ("春去秋来", "season_change"), (r"(\d+)更时分", "night_watch"), (r"(\d+)时", "hour"), ("清晨", "early_morning"), ("傍晚", "evening"),
    ("深夜", "late_night"), ("午夜", "midnight"), ("正午", "noon"), ("黄昏", "dusk"), ("黎明", "dawn"),
]

# Weights of the risk score.
RISK_WEIGHTS = {"ttr": 0.20, "sentence_variance": 0.15, "structure": 0.15, "blacklist": 0.20, "repetition": 0.15, "phrase_rep": 0.15}

# The emotion words that the curve of forty segments counts beside EMOTIONS.
RHYTHM_EXTRA = {"雀跃": ("positive", 0.8), "肝肠寸断": ("negative", 0.9)}

# Surnames that start a name, and the characters that may not follow one.
SURNAMES = "王李张刘陈杨黄赵周吴徐孙马胡朱郭何罗高林郑梁谢宋唐许韩冯邓曹彭曾萧田董潘袁于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦傅方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤温康施文牛樊葛邢安齐易乔伍庞颜倪庄聂章鲁岳翟殷詹申欧耿关兰焦俞左柳甘祝包宁尚符"
NOT_AFTER_NAME = r"，。！？、：；\"」』\)）\s"

# Words of reviews, the dimension that they speak of, and whether they blame or praise.
REVIEW_WORDS = [
    ("节奏", "pacing", "negative"), ("拖", "pacing", "negative"), ("水文", "pacing", "negative"), ("水字数", "pacing", "negative"),
    ("太慢", "pacing", "negative"), ("进展慢", "pacing", "negative"), ("节奏好", "pacing", "positive"), ("节奏快", "pacing", "positive"), ("爽快", "pacing", "positive"),
    ("角色崩", "character_consistency", "negative"), ("人设崩", "character_consistency", "negative"), ("人设", "character_consistency", "negative"), ("人物崩", "character_consistency", "negative"),
    ("性格变了", "character_consistency", "negative"), ("不出力", "character_consistency", "negative"), ("挂机", "character_consistency", "negative"),
    ("AI", "ai_score", "negative"), ("套路", "template_score", "negative"), ("模板", "template_score", "negative"), ("刻板", "template_score", "negative"),
    ("老套", "template_score", "negative"), ("千篇一律", "template_score", "negative"),
    ("读不下去", "readability", "negative"), ("太绕", "readability", "negative"), ("看不懂", "readability", "negative"), ("混乱", "readability", "negative"),
    ("费劲", "readability", "negative"), ("难读", "readability", "negative"), ("流畅", "readability", "positive"), ("好读", "readability", "positive"),
    ("情绪", "emotion_arc", "negative"), ("平淡", "emotion_arc", "negative"), ("无聊", "emotion_arc", "negative"), ("无趣", "emotion_arc", "negative"),
    ("没意思", "emotion_arc", "negative"), ("感人", "emotion_arc", "positive"), ("燃", "emotion_arc", "positive"), ("爽", "emotion_arc", "positive"),
    ("啰嗦", "redundancy", "negative"), ("废话", "redundancy", "negative"), ("重复", "redundancy", "negative"), ("车轱辘", "redundancy", "negative"),
    ("冗长", "redundancy", "negative"), ("简洁", "redundancy", "positive"),
    ("时间混乱", "timeline", "negative"), ("时间线", "timeline", "negative"), ("bug", "timeline", "negative"), ("矛盾", "timeline", "negative"),
    ("前后不对", "timeline", "negative"), ("穿帮", "timeline", "negative"),
    ("跑题", "outline_deviation", "negative"), ("大纲", "outline_deviation", "negative"), ("偏离主线", "outline_deviation", "negative"), ("偏了", "outline_deviation", "negative"),
    ("主线", "outline_deviation", "negative"), ("支线太多", "outline_deviation", "negative"), ("紧扣主线", "outline_deviation", "positive"),
]
REVIEW_NEGATIONS = ["少了", "没有", "不是", "避免", "不像", "没什么", "毫无", "不"]

# Words that negate a rule.
RULE_NEGATIONS = ["不", "并非", "不是", "没有", "禁止", "无法", "不可"]

# Advertising in scraped chapters, the ids of their containers, and suffixes of book titles.
NAVIGATION = ["请记住本书首发域名.*?，最快更新", "手机版阅读地址.*?", "最快更新.*?最新章节！", "笔趣阁.*?最快更新.*?无广告！", r"m\\.bqglll\\.cc", r"www\\.bqglll\\.cc", "一秒记住.*?：.*?。", "天才一秒记住.*?。"]
CONTENT_IDS = ["chaptercontent", "content", "txt", "article", "nr1"]
TITLE_NOISE = ["完结时间", "什么软件能看", "全文免费阅读", "免费阅读", "全文阅读", "无弹窗", "笔趣阁", "txt下载", "精校版", "最新", "全文", "完整版", "全集", "笔趣阁"]

# Passages that hint at something to come.
HINTS = ["(?:他|她|它|谁|没人).{0,5}(?:不知道|没想到|没料到|没察觉).{3,}", "(?:此刻|这时|当时).{0,5}(?:还不|尚不|未曾).{2,}(?:知道|明白|察觉|发现)", "(?:后来|多年后|很久以后).{0,5}(?:才|终于|回想起)", "(?:似乎|仿佛|隐隐|莫名|隐隐约约).{2,}(?:觉得|感到|感觉|察觉到)", "这.{0,3}(?:似乎|好像|仿佛|可能|大概).{3,}", "如果.{0,3}(?:知道|明白|看到).{3,}"]

# The module that measures a dimension of reviews, and when its metric counts as bad.
DIMENSION_MODULE = {"pacing": "pacing", "character_consistency": "stats", "ai_score": "ai_score", "readability": "stats", "emotion_arc": "emotion", "redundancy": "style_lint", "timeline": "stats", "outline_deviation": "stats", "template_score": "cross_chapter"}
THRESHOLDS = {"pacing": ("action_density", "lt", 15), "readability": ("readability.flesch_zh", "lt", 30), "emotion_arc": ("intensity_variance", "lt", 0.08), "redundancy": ("summary.total", "gte", 1), "ai_score": ("total_score", "gt", 20), "template_score": ("template_score", "gt", 30)}
DIMENSION_MAP = {"节奏": "pacing", "拖": "pacing", "水文": "pacing", "角色崩": "character_consistency", "人设": "character_consistency", "AI": "ai_score", "套路": "template_score", "模板": "template_score", "读不下去": "readability", "太绕": "readability", "情绪": "emotion_arc", "平淡": "emotion_arc", "啰嗦": "redundancy", "废话": "redundancy", "时间混乱": "timeline", "bug": "timeline", "跑题": "outline_deviation", "大纲": "outline_deviation"}
CONFIDENCE = {"matched": 0.9, "false_negative": 0.85, "false_positive": 0.7}

# Sites, the container of their chapter lists and of their chapters (by class or id), how links are meant.
SITE_RULES = {
    "bqglll.cc": ("class", "listmain", "id", "chaptercontent", "same"),
    "biquge.com.cn": ("id", "list", "id", "content", "same"),
    "biquge.info": ("class", "box_con", "id", "content", "same"),
    "biqukan.com": ("class", "listmain", "id", "content", "same"),
    "bqg5200.com": ("id", "readerlist", "id", "content", "same"),
    "23qb.com": ("id", "chapterList", "id", "TextContent", "same"),
    "biqudu.com": ("class", "box_con", "id", "content", "same"),
    "biquge.tv": ("class", "box_con", "id", "content", "same"),
    "xbiquge.la": ("class", "box_con", "id", "content", "same"),
}
SKIP_HOME = ["首页", "排行", "分类", "搜索", "关于", "登录", "注册", "更多", "全部", "书库", "书架"]
SKIP_CHAPTER = ["首页", "上一页", "下一页", "末页", "返回", "目录", "next", "prev", "home", ">>", "<<"]
SCRIPT_REMAINS = [r"document\.write.*", r"function\s+\w+\([^)]*\).*", r"if\s*\(.*?\).*", r"var\s+\w+.*"]
