"""Names, word lists and thresholds that results depend on."""

STATES = [
    "Abia", "Adamawa", "Akwa Ibom", "Anambra", "Bauchi", "Bayelsa", "Benue", "Borno", "Cross River", "Delta", "Ebonyi", "Edo", "Ekiti",
    "Enugu", "FCT", "Gombe", "Imo", "Jigawa", "Kaduna", "Kano", "Katsina", "Kebbi", "Kogi", "Kwara", "Lagos", "Nasarawa", "Niger", "Ogun",
    "Ondo", "Osun", "Oyo", "Plateau", "Rivers", "Sokoto", "Taraba", "Yobe", "Zamfara",
]
STATE_ALIASES = {"federal capital territory": "FCT", "abuja": "FCT", "fct": "FCT", "akwa-ibom": "Akwa Ibom", "cross-river": "Cross River", "nassarawa": "Nasarawa"}
FCT_NAMES = ["federal capital territory", "fct", "abuja"]
REGIONS = {
    "Northeast": ["Borno", "Yobe", "Adamawa", "Gombe", "Bauchi", "Taraba"],
    "Northwest": ["Kaduna", "Kano", "Katsina", "Zamfara", "Sokoto", "Kebbi", "Jigawa"],
    "NorthCentral": ["Plateau", "Benue", "Niger", "Kwara", "FCT", "Kogi", "Nasarawa"],
    "Southwest": ["Lagos", "Ogun", "Ondo", "Ekiti", "Osun", "Oyo"],
    "SouthSouth": ["Rivers", "Delta", "Edo", "Bayelsa", "Akwa Ibom", "Cross River"],
    "Southeast": ["Anambra", "Imo", "Abia", "Enugu", "Ebonyi"],
}
KEYWORD_STOPWORDS = [
    "the", "a", "an", "in", "on", "at", "of", "to", "and", "or", "is", "are", "was", "were", "by", "for", "from", "with", "as", "that",
    "this", "it", "its", "be", "has", "had", "have", "not", "but", "who", "which", "their", "they", "them", "been", "into", "also", "over",
    "during", "after", "before", "about", "between", "through", "including", "reportedly", "approximately", "several", "area", "local",
    "government", "state", "nigeria", "nigerian",
]
SOURCE_STOPWORDS = [
    "attack", "attacks", "attacked", "kills", "kill", "killed", "gunmen", "bandits", "terrorists", "terrorist", "unknown", "armed", "group",
    "groups", "incident", "incidents", "state", "states", "community", "communities", "village", "villages", "security", "forces", "troops",
    "police", "soldiers", "residents", "people", "breaking", "news", "report", "reports", "nigeria", "nigerian",
]
TITLE_OVERLAP_STOPWORDS = ["attack", "attacks", "incident", "nigeria", "nigerian", "state", "in"]
TOWN_FILLERS = ["near", "and", "the", "from", "area", "along", "road"]
UNKNOWN_PLACES = ["", "unknown", "n/a", "unspecified"]
VAGUE_GROUPS = ["unknown", "unidentified", "gunmen", "armed men", "armed group", "suspected"]
UNKNOWN_GROUPS = ["unknown", "unidentified", "armed men", "gunmen", "armed group"]
TRUSTED_DOMAINS = [
    "premiumtimesng.com", "thecable.ng", "gazettengr.com", "channelstv.com", "saharareporters.com", "punchng.com", "vanguardngr.com",
    "dailytrust.com", "humanglemedia.com", "guardian.ng", "dailypost.ng", "newscentral.africa", "arise.tv", "tvcnews.tv", "thisdaylive.com",
    "thenationonlineng.net", "leadership.ng", "sunnewsonline.com", "tribuneonlineng.com", "blueprint.ng", "businessday.ng", "thewhistler.ng",
    "icirnigeria.org", "ripplesnigeria.com", "dailynigerian.com", "prnigeria.com", "parallelfactsnews.com", "aljazeera.com", "bbc.com",
    "bbc.co.uk", "apnews.com", "reuters.com", "acleddata.com", "network.zagazola.org", "en.wikipedia.org", "x.com", "twitter.com", "pulse.ng",
]
TRUSTED_PUBLISHERS = [
    "Premium Times", "The Cable", "Peoples Gazette", "Channels TV", "Sahara Reporters", "Punch", "Vanguard", "Daily Trust", "HumAngle",
    "Guardian Nigeria", "The Guardian Nigeria", "Daily Post", "News Central", "Arise News", "TVC News", "ThisDay", "The Nation", "Leadership",
    "Sun News", "Tribune", "Blueprint", "Business Day", "The Whistler", "ICIR", "Ripples Nigeria", "Daily Nigerian", "PRNigeria",
    "Parallel Facts", "Parallel Facts News", "Al Jazeera", "BBC", "Associated Press", "AP", "Reuters", "ACLED", "Zagazola", "Wikipedia",
    "Twitter", "X.com", "@BrantPhilip_", "BrantPhilip", "@Sazedek", "Sazedek", "Pulse Nigeria",
]
BANNED_SOURCES = [
    "truth nigeria", "aid to the church in need", "acn international", "the journal", "council on foreign relations", "cfr.org", "trust tv",
    "trusttv", "zenit news", "youtube", "blogspot", "wordpress.com", "medium.com", "allafrica", "reliefweb", "presstv", "press tv",
    "ahram online", "al-ahram", "eastleigh voice", "graphic online", "japan today", "japan times", "straits times",
]
ASSET_EXTENSIONS = [".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".mp4", ".pdf", ".json", ".xml", ".ico"]
MORE_ASSET_EXTENSIONS = [*ASSET_EXTENSIONS, ".mp3", ".wav"]
REDIRECTOR_HOST = "vertexaisearch.cloud.google.com"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
PUBLISHER_DOMAINS = [
    ("zagazola", "zagazola"), ("premium times", "premiumtimesng.com"), ("punch", "punchng.com"), ("channels", "channelstv.com"),
    ("daily post", "dailypost.ng"), ("daily trust", "dailytrust.com"), ("vanguard", "vanguardngr.com"), ("sahara", "saharareporters.com"),
    ("humangle", "humanglemedia.com"), ("the cable", "thecable.ng"), ("peoples gazette", "gazettengr.com"), ("prnigeria", "prnigeria.com"),
    ("leadership", "leadership.ng"), ("blueprint", "blueprint.ng"), ("the nation", "thenationonlineng.net"), ("thisday", "thisdaylive.com"),
    ("tvc", "tvcnews.tv"), ("arise", "arise.tv"), ("icir", "icirnigeria.org"), ("ripples", "ripplesnigeria.com"),
    ("guardian nigeria", "guardian.ng"), ("daily nigerian", "dailynigerian.com"), ("parallel facts", "parallelfactsnews.com"),
    ("the whistler", "thewhistler.ng"), ("bbc", "bbc.com"), ("reuters", "reuters.com"), ("ap", "apnews.com"), ("al jazeera", "aljazeera.com"),
    ("voa", "voanews.com"), ("dw", "dw.com"), ("pulse", "pulse.ng"),
]
# The domain of a publisher's own pages, the first that a name holds.
PUBLISHER_TIERS = [
    ("prnigeria", "prnigeria.com"), ("daily trust", "dailytrust.com"), ("premium times", "premiumtimesng.com"), ("vanguard", "vanguardngr.com"),
    ("punch", "punchng.com"), ("channels", "channelstv.com"), ("sahara", "saharareporters.com"), ("humangle", "humanglemedia.com"),
    ("the cable", "thecable.ng"), ("peoples gazette", "gazettengr.com"), ("daily post", "dailypost.ng"), ("leadership", "leadership.ng"),
    ("the nation", "thenationonlineng.net"), ("thisday", "thisdaylive.com"), ("tvc", "tvcnews.tv"), ("arise", "arise.tv"), ("icir", "icirnigeria.org"),
    ("ripples", "ripplesnigeria.com"), ("guardian nigeria", "guardian.ng"), ("daily nigerian", "dailynigerian.com"), ("parallel facts", "parallelfactsnews.com"),
    ("whistler", "thewhistler.ng"), ("zagazola", "zagazola"), ("bbc", "bbc.com"), ("reuters", "reuters.com"), ("ap", "apnews.com"), ("al jazeera", "aljazeera.com"),
    ("voa", "voanews.com"), ("dw", "dw.com"), ("blueprint", "blueprint.ng"), ("pulse", "pulse.ng"),
]
# The patterns of the report classifiers, over lower-cased texts.
OPS_FORCE = r"\b(troops?|soldiers?|military|army|air\s*force|naf|joint\s*task\s*force|jtf|operation\s*hadin\s*kai|dhq|security\s*operatives?|police)\b"
OPS_VERB = r"\b(rescue|rescued|arrest|arrested|foiled?|foil|recover|recovered|neutrali[sz]e|neutrali[sz]ed|eliminat(?:e|ed|ing)|raid(?:ed|ing)?)\b"
OPS_ATTACK_TITLE = r"\b(boko\s*haram|iswap|bandits?|gunmen|terrorists?|insurgents?|militants?|unknown\s*gunmen)\s+(kill(?:ed|s|ing)?|abduct(?:ed|s|ing)?|attack(?:ed|s|ing)?|kidnap(?:ped|s|ping)?|storm(?:ed|s|ing)?|raid(?:ed|s|ing)?)\b"
OPS_VICTIM = r"\b(civilians?|villagers?|residents?|farmers?|passengers?|worshippers?|students?|women|children|soldiers?|troops?|police|officers?|personnel|vigilantes?)\b"
OPS_HARM = r"\b(killed|died|injured|wounded|kidnapped|abducted|attacked|ambushed|massacred|slaughtered)\b"
CLEAN_FORCE = r"\b(troops?|soldiers?|military|army|air\s*force|naf|joint\s*task\s*force|jtf|operation\s*hadin\s*kai|ophk|operation\s*whirl\s*stroke|operation\s*safe\s*haven|defence\s*headquarters?|dhq|cjtf)\b"
CLEAN_DEATHS = r"\b(neutrali[sz]ed?|eliminat(ed?|ing)|kill(ed|s|ing)?|took\s*out|wiped\s*out|gunned\s*down)\b"
CLEAN_ATTACKERS = r"\b(terrorists?|insurgents?|bandits?|militants?|iswap|boko\s*haram|fighters?|combatants?|gunmen|criminals?|kidnappers?)\b"
CLEAN_CIVILIAN_HARM = r"\b(civilians?\s*(killed|died|injured|wounded|kidnapped|abducted|displaced|affected|hurt|attacked|massacred|slaughtered))\b"
CLEAN_ROLE_HARM = r"\b(villagers?|residents?|farmers?|herders?|travell?ers?|passengers?|worshippers?|students?|women|children|teachers?|lecturers?|professors?|doctors?|nurses?|drivers?|commuters?|pastors?|imams?|clerics?|traditional\s*rulers?|monarchs?|youths?|traders?|marketers?|soldiers?|troops?|police?|officers?|personnel?|vigilantes?|hunters?|security\s*operatives?)\s*(were\s*)?(killed|died|injured|wounded|kidnapped|abducted|displaced|attacked|missing|ambushed)\b"
CLEAN_HARM_ROLE = r"\b(killed|attacked|kidnapped|abducted|murdered|assassinated|ambushed)\s*(civilians?|villagers?|residents?|farmers?|herders?|travell?ers?|passengers?|worshippers?|students?|women|children|teachers?|lecturers?|professors?|doctors?|nurses?|drivers?|commuters?|pastors?|imams?|clerics?|traditional\s*rulers?|monarchs?|youths?|traders?|marketers?|soldiers?|troops?|police?|officers?|personnel?|vigilantes?|hunters?|security\s*operatives?)\b"
CLEAN_VICTIM = r"\b(civilian|villager|resident|farmer|herder|traveller|traveler|passenger|worshipper|student|woman|child|teacher|lecturer|professor|doctor|nurse|driver|commuter|pastor|imam|cleric|monarch|youth|trader|marketer|soldier|police|officer|vigilante|hunter)\b"
CLEAN_HARM = r"\b(killed|died|injured|wounded|kidnapped|abducted|displaced|attacked|murdered|assassinated|ambushed|slaughtered|massacred)\b"
CLEAN_ACTIVE_TITLE = r"\b(boko\s*haram|iswap|bandits?|gunmen|terrorists?|insurgents?|militants?)\s+(kill(ed|s|ing)?|abduct(ed|s|ing)?|attack(ed|s|ing)?|kidnap(ped|s|ping)?|storm(ed|s|ing)?|invad(ed|s|ing)?|raid(ed|s|ing)?)"
CLEAN_RESCUE = r"\b(rescued?|freed?|liberat(ed?|ing))\s*\d*\s*(abducted|kidnapped|captive|hostage)"
CLEAN_COUNT = r"\b(neutrali[sz]ed?|eliminat(?:ed?|ing)|kill(?:ed|s|ing)?)\s+(?:more\s+than\s+)?(\d+)\s+(terrorists?|insurgents?|bandits?|militants?|fighters?|combatants?|gunmen|criminals?)"
