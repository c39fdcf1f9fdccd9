"""Word lists, lookup tables and constants that results depend on."""

AUDIENCES = ["DOMESTIC", "INTERNATIONAL", "DIASPORA"]
LEVELS = ["deepBlue", "steelBlue", "coolGray", "neutral", "amber", "orange", "red"]
CONFIDENCES = ["LOW", "MEDIUM", "HIGH"]
EXCLUDED_COUNTRIES = ["US", "GB", "UK", "CA", "AU", "NZ"]

# Hosts of platforms: audience and confidence; VARIES gives no signal.
PLATFORMS = {
    "vk.com": ("DOMESTIC", 0.90), "weibo.com": ("DOMESTIC", 0.90), "douyin.com": ("DOMESTIC", 0.95),
    "tiktok.com": ("INTERNATIONAL", 0.80), "twitter.com": ("INTERNATIONAL", 0.70),
    "x.com": ("INTERNATIONAL", 0.70), "facebook.com": ("INTERNATIONAL", 0.50), "telegram.org": ("VARIES", 0.50),
    "t.me": ("VARIES", 0.50),
}
DOMESTIC_TLDS = ["ru", "cn", "ir", "tr", "sa", "qa", "ae", "eg", "sy", "by", "ve", "cu", "kp"]
INTERNATIONAL_TLDS = ["com", "org", "net", "info", "tv", "news"]
DIASPORA_LANGUAGES = {
    "RU": ["de", "fr", "es", "he"], "CN": ["id", "ms", "th"], "TR": ["de", "nl", "fr"], "IR": ["en", "de", "fr"],
    "VN": ["en", "fr"], "UZ": ["ru"], "KZ": ["ru"]
}
SIGNAL_WEIGHTS = {"language": 0.8, "platform": 0.7, "tld": 0.3}

LANGUAGES = {
    "english": "en", "russian": "ru", "chinese": "zh", "mandarin": "zh", "arabic": "ar", "persian": "fa",
    "farsi": "fa", "spanish": "es", "french": "fr", "german": "de",
    "portuguese": "pt", "italian": "it", "japanese": "ja", "korean": "ko", "vietnamese": "vi", "tagalog": "tl",
    "filipino": "tl", "turkish": "tr", "hindi": "hi", "indonesian": "id",
    "polish": "pl", "ukrainian": "uk", "dutch": "nl", "swedish": "sv", "czech": "cs", "hungarian": "hu",
    "romanian": "ro", "serbian": "sr", "croatian": "hr", "thai": "th",
    "urdu": "ur", "malay": "ms", "swahili": "sw", "amharic": "am", "hebrew": "he", "greek": "el", "bulgarian": "bg",
    "bengali": "bn", "norwegian": "no", "danish": "da",
    "finnish": "fi", "slovak": "sk", "slovenian": "sl", "lithuanian": "lt", "latvian": "lv", "estonian": "et",
    "albanian": "sq", "macedonian": "mk", "belarusian": "be", "georgian": "ka",
    "armenian": "hy", "azerbaijani": "az", "kazakh": "kk", "uzbek": "uz", "kyrgyz": "ky", "tajik": "tg",
    "turkmen": "tk", "mongolian": "mn", "burmese": "my", "khmer": "km",
    "lao": "lo", "nepali": "ne", "sinhala": "si", "pashto": "ps", "kurdish": "ku",
}

# Bonus of country sets that act together, exact sets and pairs alike.
PAIR_BONUSES = {
    "CN,RU": 0.30, "IR,RU": 0.30, "CN,IR": 0.20, "RU,VE": 0.20, "CU,VE": 0.20, "BY,RU": 0.20, "CN,IR,RU": 0.50,
    "CU,RU,VE": 0.40
}

# Themes that wire services carry everywhere, and prefixes that are never generic.
GENERIC_THEMES = [
    "CRISISLEX_CRISISLEXREC", "CRISISLEX_C07_SAFETY", "NATURAL_DISASTER", "NATURAL_DISASTER_EARTHQUAKE",
    "NATURAL_DISASTER_FLOOD", "NATURAL_DISASTER_HURRICANE",
    "NATURAL_DISASTER_TYPHOON", "NATURAL_DISASTER_TSUNAMI", "NATURAL_DISASTER_WILDFIRE", "NATURAL_DISASTER_VOLCANO",
    "ECON_STOCKMARKET", "ECON_TAXATION", "ECON_INTEREST_RATES",
    "ECON_INFLATION", "TERROR", "TERRORISM", "KILL", "ELECTION", "WB_2670_JOBS",
]
SPECIFIC_PREFIXES = ["WB_2024_ANTI", "SOC_POINTSOFINTEREST_", "TAX_POLITICAL_PARTY_", "TAX_WORLDMAMMALS_"]

# Days (month, day) whose coverage recurs every year.
ANNIVERSARIES = {
    (1, 1): "New Year", (1, 26): "India Republic Day", (2, 11): "Iranian Revolution Day",
    (2, 16): "DPRK Kim Jong-il's birthday", (2, 24): "Russia-Ukraine war anniversary",
    (3, 8): "International Women's Day", (3, 21): "Nowruz / Persian New Year",
    (5, 1): "International Workers' Day / May Day", (5, 5): "Cinco de Mayo (Mexico)", (5, 9): "Victory Day",
    (6, 1): "International Children's Day", (6, 4): "Tiananmen anniversary (China)", (6, 12): "Russia Day",
    (7, 1): "Hong Kong handover anniversary / China CCP founding", (7, 4): "US Independence Day",
    (8, 6): "Hiroshima anniversary", (8, 9): "Nagasaki anniversary",
    (8, 15): "India Independence Day / Korea Liberation Day", (9, 1): "Start of WWII anniversary",
    (9, 3): "China Victory Over Japan Day",
    (9, 9): "DPRK founding anniversary", (9, 11): "9/11 anniversary", (10, 1): "China National Day / DPRK",
    (10, 7): "Russia Putin's birthday", (11, 4): "Russia Unity Day",
    (11, 7): "October Revolution anniversary (Russia)", (12, 25): "Christmas",
    (12, 26): "Boxing Day / Soviet Union dissolution anniversary (1991)",
    (12, 30): "DPRK Kim Jong-il death anniversary", (12, 31): "New Year's Eve",
}

# Keywords of the narratives that texts are scored for.
NARRATIVES = {
    "NATO_AGGRESSION": ["nato", "expansion", "provocation", "encirclement", "threat"],
    "WESTERN_HYPOCRISY": ["double standard", "hypocrisy", "selective", "rules-based"],
    "SOVEREIGNTY": ["sovereignty", "internal affairs", "interference", "self-determination"],
    "ECONOMIC_COERCION": ["sanctions", "economic warfare", "coercion", "weaponize"],
    "MULTIPOLARITY": ["multipolar", "new world order", "BRICS", "dedollarization"],
    "WESTERN_DECLINE": ["decline", "collapse", "crisis", "failing", "divided"],
    "DEVELOPMENT_MODEL": ["belt and road", "development", "infrastructure", "partnership"],
    "MILITARY_STRENGTH": ["military", "defense", "capability", "modernization", "exercise"],
    "SOCIAL_DECAY": ["crime", "drugs", "homelessness", "immigration crisis"],
    "TECHNOLOGY_LEADERSHIP": ["innovation", "technology", "AI", "space", "5G"],
    "TAIWAN_SOVEREIGNTY": ["taiwan", "one china", "reunification", "separatist"],
    "UKRAINE_SPECIAL_OP": ["special operation", "denazification", "kiev regime"],
    "PALESTINE_SOLIDARITY": ["palestine", "occupation", "resistance", "zionist"],
    "GULF_RIVALRY": ["qatar", "saudi", "blockade", "normalization"],
    "REGIME_LEGITIMACY": ["election", "support", "prosperity", "stability", "unity"],
    "HUMANITARIAN_AID": ["aid", "humanitarian", "assistance", "cooperation"],
}

# Columns of a theme file's lines: place of each field that is read.
GKG_FIELDS = {"record_id": 0, "date": 1, "source": 3, "url": 4, "themes": 7, "tone": 15, "extras": 26}
GKG_LEAST_FIELDS = 17

#: Fixed: English stop words of titles, as Spark's own remover lists them.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now i'll "
    "you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would "
).split()
