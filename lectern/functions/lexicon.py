"""Word lists of the rules. Everything here is a table of fixed values."""

from __future__ import annotations



# Chinese words often written wrongly, each with the right form.
CHINESE_TYPOS = {
    "帐号": "账号", "帐户": "账户", "帐单": "账单", "帐目": "账目", "帐款": "账款", "帐本": "账本", "按装": "安装", "震憾": "震撼", "烦燥": "烦躁", "气慨": "气概", "膺品": "赝品", "按奈": "按捺",
    "一股作气": "一鼓作气", "悬梁刺骨": "悬梁刺股", "融汇贯通": "融会贯通", "默守成规": "墨守成规", "迫不急待": "迫不及待", "变本加利": "变本加厉", "走头无路": "走投无路", "拾人牙惠": "拾人牙慧", "甘败下风": "甘拜下风",
    "始终不逾": "始终不渝", "无微不致": "无微不至", "不可思异": "不可思议", "名列前矛": "名列前茅", "巧夺天功": "巧夺天工", "破斧沉舟": "破釜沉舟", "滥芋充数": "滥竽充数", "原形必露": "原形毕露", "浮想连翩": "浮想联翩",
    "貌和神离": "貌合神离", "汗流夹背": "汗流浃背", "陈词烂调": "陈词滥调", "不径而走": "不胫而走", "按步就班": "按部就班", "鞭辟入理": "鞭辟入里", "关怀倍至": "关怀备至", "好高鹜远": "好高骛远", "黄梁美梦": "黄粱美梦",
    "流光异彩": "流光溢彩", "鬼鬼崇崇": "鬼鬼祟祟", "饮鸠止渴": "饮鸩止渴", "如火如茶": "如火如荼", "贪脏枉法": "贪赃枉法", "脍灸人口": "脍炙人口", "委屈求全": "委曲求全", "声名雀起": "声名鹊起", "凭心而论": "平心而论",
    "事得其反": "适得其反", "谈笑风声": "谈笑风生", "不加思索": "不假思索", "一诺千斤": "一诺千金", "鼎立相助": "鼎力相助", "人情事故": "人情世故", "人才汇萃": "人才荟萃", "颠复": "颠覆", "松驰": "松弛",
    "一张一驰": "一张一弛", "泊来品": "舶来品", "侯车室": "候车室", "侯选人": "候选人", "冒然": "贸然", "幅射": "辐射", "天翻地复": "天翻地覆", "言简意骇": "言简意赅", "不落巢臼": "不落窠臼", "脏款": "赃款",
    "装祯": "装帧", "渡假": "度假", "欢渡": "欢度", "兰天白云": "蓝天白云", "九洲": "九州", "做月子": "坐月子", "蓝球": "篮球", "既使": "即使", "做为": "作为", "涉及到": "涉及", "付诸于": "付诸",
    "凯旋归来": "凯旋", "免费赠送": "赠送", "互相厮打": "厮打",
}
# Those of them that repeat a meaning.
REDUNDANT_WORDS = frozenset("涉及到 付诸于 凯旋归来 免费赠送 互相厮打".split())

# English misspellings, each with the right form.
ENGLISH_TYPOS = {
    "teh": "the", "recieve": "receive", "occured": "occurred", "seperate": "separate", "definately": "definitely", "neccessary": "necessary",
    "occassion": "occasion", "accomodate": "accommodate", "arguement": "argument", "beleive": "believe", "calender": "calendar",
    "cemetary": "cemetery", "changable": "changeable", "collegue": "colleague", "comming": "coming", "commitee": "committee", "concious": "conscious",
    "definitly": "definitely", "desireable": "desirable", "disipline": "discipline", "embarass": "embarrass", "enviroment": "environment",
    "existance": "existence", "experiance": "experience", "familar": "familiar", "finaly": "finally", "florescent": "fluorescent",
    "foriegn": "foreign", "goverment": "government", "gramar": "grammar", "happend": "happened", "harras": "harass", "knowlege": "knowledge",
    "liason": "liaison", "libary": "library", "lisence": "license", "maintainance": "maintenance", "millenium": "millennium",
    "noticable": "noticeable", "persistant": "persistent", "posession": "possession", "prefered": "preferred", "priviledge": "privilege",
    "probaly": "probably", "publically": "publicly", "realy": "really", "recomend": "recommend", "refered": "referred", "religous": "religious",
    "repetion": "repetition", "rythm": "rhythm", "sieze": "seize", "similiar": "similar", "sincerly": "sincerely", "speach": "speech",
    "tommorow": "tomorrow", "tounge": "tongue", "truely": "truly", "unfortunatly": "unfortunately", "untill": "until", "wierd": "weird",
    "writeing": "writing", "alot": "a lot", "thier": "their", "tommorrow": "tomorrow", "wich": "which", "thru": "through",
    "occassionally": "occasionally", "accross": "across", "adress": "address", "allmost": "almost", "allready": "already", "allways": "always",
    "apparant": "apparent", "appearence": "appearance", "becuase": "because", "begining": "beginning", "buisness": "business",
    "camoflauge": "camouflage", "carefull": "careful", "carrer": "career", "catagory": "category", "cliches": "cliches", "collaegue": "colleague",
    "completly": "completely", "controled": "controlled", "defendent": "defendant", "definatly": "definitely", "desination": "destination",
    "dissapoint": "disappoint", "dissappear": "disappear", "dissaster": "disaster", "doubtfull": "doubtful", "eigth": "eighth",
    "embarras": "embarrass", "enviromental": "environmental", "exagerate": "exaggerate", "excellant": "excellent", "expresso": "espresso",
    "facillitate": "facilitate", "firey": "fiery", "flourescent": "fluorescent", "forseeable": "foreseeable", "fourtune": "fortune",
    "freind": "friend", "furneral": "funeral", "gaurd": "guard", "grammer": "grammar", "happyness": "happiness", "harrased": "harassed",
    "heirarchy": "hierarchy", "hellow": "hello", "hierachy": "hierarchy", "horrifyed": "horrified", "humerous": "humorous", "hygenic": "hygienic",
    "hypocracy": "hypocrisy", "idiosyncracy": "idiosyncrasy", "imitiate": "imitate", "immidiately": "immediately", "independant": "independent",
    "indispensible": "indispensable", "innoculate": "inoculate", "intelectual": "intellectual", "inteligent": "intelligent", "interupt": "interrupt",
    "irresistable": "irresistible", "jist": "gist", "knowlegable": "knowledgeable", "labatory": "laboratory", "lenght": "length",
    "liesure": "leisure", "liquify": "liquefy", "loosing": "losing", "managable": "manageable", "medeval": "medieval", "millepede": "millipede",
    "miniscule": "minuscule", "mischievious": "mischievous", "mispell": "misspell", "momento": "memento", "necesary": "necessary",
    "noticably": "noticeably", "nucular": "nuclear", "ommision": "omission", "orignal": "original", "outragous": "outrageous",
    "pavillion": "pavilion", "percieve": "perceive", "perseverence": "perseverance", "personell": "personnel", "persue": "pursue",
    "playright": "playwright", "possesion": "possession", "potatos": "potatoes", "presense": "presence", "primative": "primitive",
    "professer": "professor", "promiss": "promise", "pronounciation": "pronunciation", "prophecey": "prophecy", "quanitity": "quantity",
    "questionaire": "questionnaire", "quizes": "quizzes", "reccomend": "recommend", "reciept": "receipt", "rediculous": "ridiculous",
    "reguard": "regard", "relevent": "relevant", "repitition": "repetition", "resistence": "resistance", "secratary": "secretary", "seige": "siege",
    "sheild": "shield", "similer": "similar", "supercede": "supersede", "supress": "suppress", "surprize": "surprise", "tempature": "temperature",
    "tendancy": "tendency", "threshhold": "threshold", "twelth": "twelfth", "tyrany": "tyranny", "underate": "underrate", "upholstry": "upholstery",
    "vaccum": "vacuum", "vehical": "vehicle", "wellfare": "welfare", "wilfull": "willful", "writting": "writing", "yatch": "yacht", "yeild": "yield",
}

# Truncated idioms and the sign each lacks.
TRUNCATED_IDIOMS = {
    "迫不及": "迫不及待", "不言而": "不言而喻", "不约而": "不约而同", "一知半": "一知半解", "一鼓作": "一鼓作气", "一帆风": "一帆风顺", "一丝不": "一丝不苟", "不假思": "不假思索", "理所当": "理所当然",
    "顺理成": "顺理成章", "无微不": "无微不至", "有目共": "有目共睹", "举一反": "举一反三", "相辅相": "相辅相成", "相得益": "相得益彰", "破釜沉": "破釜沉舟", "墨守成": "墨守成规", "融会贯": "融会贯通",
    "潜移默": "潜移默化", "精打细": "精打细算", "胸有成": "胸有成竹", "旗开得": "旗开得胜", "首屈一": "首屈一指", "刻不容": "刻不容缓",
}

# Words in a spelling that is not recommended, each with the recommended one.
VARIANT_WORDS = {
    "帐户": "账户", "帐号": "账号", "帐单": "账单", "帐目": "账目", "帐款": "账款", "帐本": "账本", "脚色": "角色", "搭当": "搭档", "蹓跶": "溜达", "车箱": "车厢", "定货": "订货", "定购": "订购",
    "定阅": "订阅", "定单": "订单", "抹煞": "抹杀", "折魔": "折磨", "辈份": "辈分", "份量": "分量", "身分": "身份", "图象": "图像", "录象": "录像", "想像": "想象", "象徵": "象征", "交待": "交代",
}

# Radicals that stand for ordinary signs.
RADICALS = {
    "⻔": "门", "⻳": "龟", "⻰": "龙", "⻢": "马", "⻛": "风", "⻜": "飞", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "龟", "⻫": "齐",
    "⻬": "齐", "⻭": "齿", "⻮": "齿", "⻯": "龙", "⻱": "龟", "⻲": "龟", "\u2ef5": "门", "\u2ef6": "斗", "\u2ef7": "斗", "\u2ef8": "斗", "\u2ef9": "斗",
    "\u2efa": "斗", "\u2efb": "斗", "⼀": "一", "⼆": "二", "⼈": "人", "⼊": "入", "⼏": "几", "⼝": "口", "⼟": "土", "⼤": "大", "⼥": "女", "⼦": "子", "⼩": "小",
    "⼭": "山", "⼯": "工", "⼰": "己", "⼲": "干", "⼼": "心", "⼿": "手", "⽂": "文", "⽅": "方", "⽆": "无", "⽇": "日", "⽉": "月", "⽊": "木", "⽔": "水", "⽕": "火",
    "⽜": "牛", "⽝": "犬", "⽟": "玉", "⽣": "生", "⽤": "用", "⽥": "田", "⽩": "白", "⽬": "目", "⽯": "石", "⽴": "立", "⽵": "竹", "⽶": "米", "⽹": "网", "⽺": "羊",
    "⽼": "老", "⽽": "而", "⽿": "耳", "⾁": "肉", "⾃": "自", "⾄": "至", "⾊": "色", "⾍": "虫", "⾎": "血", "⾏": "行", "⾐": "衣", "⾒": "见", "⾓": "角", "⾔": "言",
    "⾕": "谷", "⾖": "豆", "⾙": "贝", "⾚": "赤", "⾛": "走", "⾜": "足", "⾝": "身", "⾞": "车", "⾦": "金", "⾧": "长", "⾩": "门", "⾬": "雨", "⾯": "面", "⾰": "革",
    "⾵": "风", "⾶": "飞", "⾷": "食", "⾸": "首", "⾹": "香", "⾺": "马", "⾻": "骨", "⾼": "高", "⿁": "鬼", "⿂": "鱼", "⿃": "鸟", "⿄": "卤", "⿅": "鹿", "⿆": "麦",
    "⿇": "麻", "⿈": "黄", "⿊": "黑", "⿑": "齐", "⿒": "齿", "⿓": "龙", "⿔": "龟",
}

# Idioms often misused, with what may be meant.
MISUSED_IDIOMS = {
    "差强人意": ("不尽如人意", "令人失望", "难以令人满意"),
    "空穴来风": ("无中生有", "凭空捏造", "毫无根据"),
    "昨日黄花": ("明日黄花",),
    "七月流火": ("骄阳似火", "烈日当空", "酷暑难耐"),
    "望其项背": ("难以望其项背", "望尘莫及", "不可企及"),
    "万人空巷": ("人迹罕至", "门可罗雀", "冷冷清清"),
    "不以为然": ("不以为意", "毫不在意", "并不在意"),
    "炙手可热": ("广受欢迎", "备受追捧", "风靡一时"),
    "首当其冲": ("一马当先", "冲锋在前", "身先士卒"),
    "溢美之言": ("溢美之词",),
}

# First part of a pair of conjunctions, the parts that may follow, and how the pair is named.
CONJUNCTIONS = (
    ("虽然", ("但是", "却", "然而", "可是", "但仍", "但还"), "虽然……但是/却"),
    ("尽管", ("但是", "却", "然而", "可是", "但仍", "但还"), "尽管……但是/却"),
    ("不但", ("而且", "还", "也"), "不但……而且"),
    ("不仅", ("而且", "还", "也"), "不仅……而且"),
    ("既然", ("就", "那"), "既然……就"),
    ("只要", ("就",), "只要……就"),
    ("只有", ("才",), "只有……才"),
    ("无论", ("都", "也"), "无论……都"),
    ("不管", ("都", "也"), "不管……都"),
    ("与其", ("不如",), "与其……不如"),
    ("宁可", ("也不", "也要"), "宁可……也不/也要"),
    ("即使", ("也",), "即使……也"),
    ("哪怕", ("也",), "哪怕……也"),
    ("一方面", ("另一方面",), "一方面……另一方面"),
)

# Names of the same thing, the one to prefer first.
SYNONYMS = (
    ("苹果公司", "Apple公司", "Apple", "Apple Inc.", "蘋果公司"), ("谷歌", "Google", "谷歌公司", "Google公司"), ("微软", "Microsoft", "微软公司", "Microsoft公司"),
    ("腾讯", "Tencent", "腾讯公司"), ("字节跳动", "ByteDance"), ("亚马逊", "Amazon"), ("脸书", "Facebook"), ("特斯拉", "Tesla"), ("华为", "Huawei", "华为公司"),
    ("阿里巴巴", "Alibaba", "阿里"), ("人工智能", "AI"), ("机器学习", "ML"), ("深度学习", "DL"), ("虚拟现实", "VR"), ("增强现实", "AR"), ("混合现实", "MR"), ("自然语言处理", "NLP"),
    ("物联网", "IoT"), ("区块链", "Blockchain"), ("应用程序", "APP", "App"), ("操作系统", "OS"), ("数据库", "Database"), ("云计算", "Cloud Computing"),
    ("新冠肺炎", "COVID-19", "COVID"), ("世界卫生组织", "WHO"), ("联合国", "UN"), ("国际货币基金组织", "IMF"), ("北京", "北京市"), ("上海", "上海市"),
    ("美国", "USA", "United States", "美利坚合众国"), ("英国", "UK", "United Kingdom"),
)

# Superlatives that advertising may not use.
SUPERLATIVES = (
    "国家级", "最高级", "最佳", "顶级", "极致", "极品", "第一", "唯一", "首席", "首选", "王牌", "首个", "首款", "销量第一", "第一品牌", "领导品牌", "领先品牌", "世界领先", "国际领先", "全球领先", "全球首发",
    "全网最低", "史上最", "绝无仅有", "前无古人", "史无前例", "空前绝后", "举世无双", "独一无二", "万能", "百分之百", "永久", "永远", "至尊", "领袖", "独家", "绝版", "鼻祖", "始祖", "祖传", "纯天然", "无添加",
    "零风险",
)

# Places that need a prefix.
TERRITORIES = {"香港": "中国香港", "台湾": "中国台湾", "澳门": "中国澳门"}

# Verbs and their third person.
THIRD_PERSON = {
    "go": "goes", "have": "has", "do": "does", "work": "works", "walk": "walks", "run": "runs", "eat": "eats", "play": "plays", "like": "likes",
    "need": "needs", "want": "wants", "know": "knows", "say": "says", "make": "makes", "take": "takes", "use": "uses",
}

# Layer of each issue type; `discourse` for all others.
LAYERS = {t: layer for layer, types in {
    "character": "typo variant_char width_mixed", "vocabulary": "missing_char idiom_misuse custom_term term_consistency", "sentence": "expression grammar logic",
    "format": "punctuation spacing number_format", "discourse": "repetition style colloquial banned_word",
    "security": "pii_id pii_phone pii_email pii_bank pii_key sensitive_politics sensitive_ethnic_religion sensitive_territory ad_extreme",
}.items() for t in types.split()}
LAYER_ORDER = ("character", "vocabulary", "sentence", "format", "discourse", "security")
LAYER_LABELS = dict(zip(LAYER_ORDER, ("字符层", "词汇层", "句子层", "标点/格式层", "语篇/语体层", "合规/安全层")))
# Default confidence of a rule; 0.7 for all others.
CONFIDENCE = {"cn_typo": 0.95, "en_spelling": 0.95, "custom_glossary": 1.0, "banned_word": 1.0, "irregular_char": 0.95, "mixed_punct": 0.85, "half_in_cn_context": 0.85, "multi_space": 0.9, "redundant_de": 0.75}

# Spoken expressions, each with written ones; of use only where a check for them is asked for.
COLLOQUIAL = {
    "然后": ("随后", "继而", "此后"), "就是说": ("即", "也就是说", "换言之"), "所以说": ("因此", "由此可见", "故而"), "其实吧": ("其实", "实际上", "事实上"), "反正": ("无论如何", "总之", "不管怎样"),
    "咱们": ("我们", "我方", "本公司"), "啥": ("什么", "何种"), "咋": ("怎么", "如何", "怎样"), "特别地": ("尤其", "格外", "特别"), "非常地": ("十分", "极为", "非常"),
    "挺好的": ("较好", "良好", "尚可"), "挺不错的": ("优秀", "出色", "良好"), "搞": ("做", "进行", "完成"), "弄": ("做", "处理", "准备"), "咱们公司": ("本公司", "我公司", "我司"),
    "一块儿": ("一起", "一同", "共同"), "赶紧": ("尽快", "迅即", "加紧"), "马上就": ("即将", "随即", "立刻"), "有点儿": ("略有", "稍有", "有些"), "一点儿": ("稍", "略", "些许"),
}
