"""Fixed values of the text functions: word lists, maps and patterns that results depend on."""

#: Texts that count as missing, compared in lower case.
PLACEHOLDERS = ("na", "n/a", "nan", "none", "null", "undefined", "")

#: English contractions; the longest is expanded first.
CONTRACTIONS = {
    "don't": "do not", "can't": "cannot", "won't": "will not", "shouldn't": "should not", "wouldn't": "would not", "couldn't": "could not", "didn't": "did not", "doesn't": "does not",
    "aren't": "are not", "isn't": "is not", "wasn't": "was not", "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not",
    "i'm": "i am", "you're": "you are", "he's": "he is", "she's": "she is", "it's": "it is", "we're": "we are", "they're": "they are", "i've": "i have", "you've": "you have", "we've": "we have", "they've": "they have",
    "i'll": "i will", "you'll": "you will", "he'll": "he will", "she'll": "she will", "we'll": "we will", "they'll": "they will", "i'd": "i would", "you'd": "you would", "he'd": "he would", "she'd": "she would", "we'd": "we would", "they'd": "they would",
    "what's": "what is", "that's": "that is", "who's": "who is", "where's": "where is", "when's": "when is", "why's": "why is", "how's": "how is", "there's": "there is", "here's": "here is", "let's": "let us", "it'd": "it would",
    "ain't": "is not", "shan't": "shall not", "mightn't": "might not", "mustn't": "must not", "needn't": "need not", "daren't": "dare not", "oughtn't": "ought not",
    "can't've": "cannot have", "couldn't've": "could not have", "shouldn't've": "should not have", "wouldn't've": "would not have", "it's been": "it has been",
    "gonna": "going to", "wanna": "want to", "gotta": "got to", "idk": "i do not know", "smh": "shaking my head", "tbh": "to be honest", "nothin": "nothing",
}

#: English words of social media that are no content. A parameter of the tokenizer, as are the two lists below.
ENGLISH_NOISE = (
    "gt", "ur", "thats", "ive", "im", "wa", "ha", "na", "gon", "ie", "eg", "inc", "idk", "dunno", "ugh", "sigh", "pls", "plz", "edit", "tldr", "op", "upvote", "downvote", "just", "people", "url", "lol", "lmao", "thx", "ty",
    "yw", "fyi", "btw", "omg", "amp", "imo", "stop", "stops", "stopped", "stopping", "http", "https", "www", "com", "co", "org", "net", "io",
)
ENGLISH_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "of", "to", "in", "on", "at", "by", "for", "with", "from", "as", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they",
    "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "am", "do", "does", "did", "have", "has", "had", "so", "than", "then", "there", "which", "who", "what",
)
#: Kept although they are stopwords elsewhere: negations and discourse words. "justmaybe" is one word in the list results depend on.
ENGLISH_KEPT = (
    "almost", "already", "also", "always", "anymore", "anyway", "even", "ever", "generally", "justmaybe", "often", "quite", "really", "somehow", "sometime", "sometimes", "still", "usually", "very",
    "actually", "basically", "certainly", "clearly", "constantly", "definitely", "honestly", "lately", "literally", "obviously", "probably", "recently", "seriously", "somewhat", "suddenly", "totally", "truly",
    "never", "no", "nobody", "none", "not", "nothing",
)

#: Code point ranges of emojis.
EMOJIS = (
    "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{2600}-\\x{26FF}\\x{2700}-\\x{27BF}\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{1F1E0}-\\x{1F1FF}\\x{1F700}-\\x{1F77F}"
    "\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}\\x{3000}-\\x{303F}\\x{FE00}-\\x{FE0F}\\x{1F000}-\\x{1F02F}\\x{1F0A0}-\\x{1F0FF}\\x{2300}-\\x{23FF}\\x{2100}-\\x{21FF}]"
)
CONTROLS = "[\\x00-\\x1F\\x7F-\\x9F\\x{FFFD}\\x{FEFF}]"

#: Emoticons, without the word boundaries that are put around all but the shrug; letter case does not matter.
EMOTICONS = (
    r":-?\)+", r":-?\(+", r":-?D", r"D:", r":-?P", r":-?/", r":-?O", r":-?\|", r":-?\*", r":-?@", r";-?\)+", r";-?\(+", r"T[_\-\.]T", r"[=8][\-o]?[)\(DP]", r">:[\(\)]", r"-_+-", r"u_u", r"\^[_\-\.]?\^", r"\^+",
    r"x-?D", r"XD", r"</?3", r"\\o/", r"o/", r"O\.?o", r"o\.?O",
)
SHRUG = r"¯\\_\(ツ\)_/¯"

#: French words that are no content, and those kept.
FRENCH_STOPWORDS = (
    "je", "j", "tu", "il", "elle", "nous", "vous", "ils", "elles", "on", "me", "moi", "te", "toi", "se", "mon", "ma", "mes", "ton", "ta", "tes", "son", "sa", "ses", "notre", "nos", "votre", "vos", "leur", "leurs",
    "le", "la", "les", "un", "une", "des", "du", "au", "aux", "de", "à", "en", "dans", "sur", "avec", "pour", "par", "sans", "chez", "et", "ou", "mais", "donc", "or", "ni", "car", "que", "qui", "quand", "lorsque", "comme", "puisque",
    "quoique", "quoi", "si", "afin", "bien", "pendant", "avant", "après", "depuis", "jusqu", "malgré", "chaque", "tous", "toutes", "tout", "toute", "ce", "cet", "cette", "ces", "autre", "autres", "même", "mêmes", "cela", "ceci",
    "celui", "celle", "ceux", "celles", "m", "n", "s", "t", "quelqu", "aujourd", "hui", "pa", "être", "avoir", "suis", "es", "est", "sommes", "êtes", "sont", "étais", "était", "étions", "étiez", "étaient",
    "serai", "seras", "sera", "serons", "serez", "seront", "serais", "serait", "serions", "seriez", "seraient", "sois", "soit", "soyons", "soyez", "soient", "ai", "as", "a", "avons", "avez", "ont", "avais", "avait", "avions", "aviez", "avaient",
    "aurai", "auras", "aura", "aurons", "aurez", "auront", "aurais", "aurait", "aurions", "auriez", "auraient", "aie", "aies", "ait", "ayons", "ayez", "aient", "été", "eu",
)
FRENCH_KEPT = (
    "ne", "pas", "rien", "personne", "jamais", "plus", "toujours", "parfois", "tellement", "trop", "dépression", "pensées", "vide", "douleur", "désespoir", "espoir", "suicidaires", "lumière", "obscurité", "âme", "résilience", "guérison",
)
#: What word clouds leave out besides: French words, and English ones.
FRENCH_CLOUD = (
    "ne", "pas", "rien", "personne", "jamais", "très", "trop", "toujours", "parfois", "tellement", "plus", "bien", "vraiment", "encore", "déjà", "assez", "peu", "beaucoup", "moins", "autant",
)
ENGLISH_CLOUD = ("just", "get", "got", "go", "know", "want", "make", "thing", "time", "day", "way", "say", "come", "look", "one")
#: French emoticons, letter case aside: each pattern counts by itself.
FRENCH_EMOTICONS = (r":\)|:-\)|:\]|=\]|=\)", r":\(|:-\(|:\[|=\[|=\(", r":D|:-D|=D", r";\)|;-\)", r":P|:-P|=P", r":o|:-o|:O|:-O", r":/|:-/", r":'\(", r"<3")

#: Suffix rules of lemmas, the longest that fits first, and the letters that must stay before it; irregular forms come before any
#: rule. Own choices, and parameters of ``text.lemma``.
ENGLISH_LEMMAS = (("ational", "ate"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("sses", "ss"), ("ying", "y"), ("ies", "y"), ("ied", "y"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("ing", ""), ("ed", ""), ("ss", "ss"), ("us", "us"), ("is", "is"), ("s", ""))
ENGLISH_IRREGULAR = {
    "was": "be", "were": "be", "is": "be", "are": "be", "am": "be", "been": "be", "has": "have", "had": "have", "did": "do", "does": "do", "done": "do", "went": "go", "gone": "go", "said": "say", "made": "make", "felt": "feel", "thought": "think",
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "better": "good", "best": "good", "worse": "bad", "worst": "bad", "this": "this", "his": "his", "nothing": "nothing", "thing": "thing",
}
FRENCH_LEMMAS = (("issements", "issement"), ("euses", "eux"), ("euse", "eux"), ("trices", "teur"), ("trice", "teur"), ("aient", "er"), ("eaux", "eau"), ("aux", "al"), ("ées", "er"), ("és", "er"), ("ée", "er"), ("é", "er"), ("ait", "er"), ("ais", "er"), ("ant", "er"), ("ez", "er"), ("s", ""))
FRENCH_IRREGULAR = {"suis": "être", "est": "être", "sont": "être", "était": "être", "été": "être", "ai": "avoir", "a": "avoir", "ont": "avoir", "avait": "avoir", "eu": "avoir", "vais": "aller", "va": "aller", "vont": "aller", "fait": "faire", "font": "faire", "pas": "pas", "plus": "plus", "sans": "sans", "temps": "temps", "dans": "dans", "jamais": "jamais", "mais": "mais"}

#: Arabic: umbrella classes by the first pattern that a normalised label matches, in this order.
UMBRELLAS = (
    ("suicidality_selfharm", "انتحار|انتحاري|افكار انتحاريه|قتل النفس|ايذاء النفس|ايذاء الذات"),
    ("bipolar_mania", "ثنائي القطب|اضطراب وجداني|هوس واكتئاب|هوس"),
    ("attention_hyperactivity", "فرط الحركه|تشتت|نقص الانتباه|ضعف الانتباه|قصور الانتباه"),
    ("ocd_obsessive", "وسواس|وساوس|قهري|افكار وسواسيه|افعال وسواسيه"),
    ("anxiety_fear", "قلق|توتر|هلع|هرع|رهاب|مخاوف|خوف|فوبيا|انطواء|عزله|القلق الاكتئابي|اكتئابي قلقي"),
    ("depression", "اكتئاب|اكتياب|كابه|كآبه|حزن|مزاج منخفض"),
    ("normal_reassurance", "طبيعي|سليم|لا اعاني|لا يوجد مرض|عادي|طمانه|اطمئنان"),
)
OTHER_UMBRELLA = "other_unclear"
DOCTOR_WORDS = "تشخيص|شخص|ما رايكم|ما رأيكم|رايكم|دكتور|طبيب|العلاج|دواء|جرعه|جرعة|استشاره|استشارة|افيدوني|تنصحوني"
PATIENT_WORDS = "اشعر|اعاني|احس|اخاف|افكر|لا استطيع|لااستطيع|انا|عندي|لدي|ينتابني|اصبت|اعيش|اكره|احب|انام|اخشى"
ARABIC_PREFIXES = ("وال", "بال", "كال", "فال", "لل", "ال", "و", "ف", "ب", "ك", "ل")
ARABIC_SUFFIXES = ("كما", "هما", "كم", "كن", "نا", "ها", "هم", "هن", "ات", "ون", "ين", "ان", "ه", "ي")
#: Words that keep their article; words before which "and" and "so" are cut off; negations, which are no stopwords.
ARABIC_WITH_ARTICLE = ("الله", "الهي", "الهيه", "الرحمن", "الرحيم", "الان", "الانسان", "الناس", "الذي", "التي", "الذين", "اللاتي", "اللاتى", "اللهم", "القران", "الحديث")
ARABIC_DISCOURSE = (
    "شكرا", "شكرًا", "الحمد", "الله", "السلام", "عليكم", "رحمه", "رحمة", "بركاته", "جزاكم", "جزاك", "ارجو", "أرجو", "افيدوني", "أفيدوني", "دكتور", "الدكتور", "طبيب", "الطبيب", "سؤالي", "السؤال", "تشخيصكم", "حالتي", "لو", "سمحتم", "خير", "الشكر", "جزيلا",
)
ARABIC_NEGATIONS = ("لا", "لم", "لن", "ليس", "ليست", "لست", "لسنا", "بدون", "بلا", "مش", "مو", "مافي", "ما في")
#: Stopwords as they are written: general ones, those of consultations, of the labels, and of the data.
ARABIC_GENERAL = (
    "في", "من", "على", "إلى", "الى", "عن", "ما", "ماذا", "هذا", "هذه", "ذلك", "تلك", "هو", "هي", "هم", "هن", "أنا", "انا", "نحن", "كان", "كانت", "يكون", "يمكن", "لقد", "قد", "ثم", "أو", "او", "و", "ف", "ب", "ل", "ك", "مع", "عند", "بعد", "قبل", "كل",
    "أي", "اي", "أحد", "احد", "هناك", "هنا", "لكن", "ولكن", "لأن", "لان", "إن", "ان", "إذا", "اذا", "حتى", "حتي", "بين", "أكثر", "اكثر", "أقل", "اقل", "أيضًا", "ايضا", "أحيانًا", "احيانا", "ولا", "لا", "لم", "لن", "لي", "لدي", "عندي", "عنده", "عندها",
    "الذي", "التي", "الذين", "اللاتي", "اللاتى", "شيء", "بعض", "أمر", "أمور", "كنت", "وأنا", "وانا", "أنني", "انني", "أنها", "انها", "أنه", "انه", "اني", "هل", "عندما", "منذ", "الآن", "الان", "الا", "إلا", "حول", "حيث", "بسبب", "جدا", "جدًا", "كما", "تم",
    "علي", "عليه", "عليها", "اشعر", "أشعر", "واشعر", "اعاني", "أعاني", "احس", "أحس", "اريد", "أريد", "استطيع", "أستطيع", "اعرف", "أعرف", "امي", "أمي", "ابي", "أبي", "الي", "وفي", "وهل", "فهل", "وما", "فانا", "بان", "ام", "مره", "غير", "الحاله", "الحالة",
    "حالتي", "حالاتي", "وعدم", "كثيرا", "سنه", "سنة", "لمده", "مدة", "لله", "ورحمه", "ورحمة", "وقد", "فقد", "وكان", "وكانت", "ايضا", "ايضاً",
)
ARABIC_CONSULTATION = (
    "السلام", "عليكم", "ورحمة", "وبركاته", "جزاكم", "خيرا", "خيرًا", "شكرا", "شكرًا", "أرجو", "ارجو", "افيدوني", "أفيدوني", "سؤالي", "السؤال", "الإجابة", "الاخ", "الأخ", "الاخت", "الأخت", "حفظه", "حفظها", "بارك", "بكم", "نسأل", "تعالى", "وفقكم", "الله",
    "بسم", "الرحمن", "الرحيم", "وبعد", "الفاضل", "الفاضلة", "كريم", "كريمة", "استشارتي", "استشارة", "جواب", "سؤالك", "رسالتك", "الموقع", "ويب", "اسلام", "إسلام", "المكرم", "المكرمة", "الدكتور", "الدكتورة", "استفسار", "استفساري", "ارجوكم", "لو", "سمحتم",
    "جزاك", "الرجاء", "أرجوكم", "حضرتك", "ممكن", "ممکن", "طبيب", "الطبيب", "دكتور", "علما", "علماً", "اعلم", "جزيل", "الشكر", "خير", "الجزاء", "صاحب", "الاستشاره", "الاستشارة", "رقم", "الرسول", "صلي", "وسلم", "الحمد",
)
ARABIC_LABEL_WORDS = ("الحالات", "النفسيه", "العصبيه", "العصبية", "عموما", "عموماً")
ARABIC_DATA_WORDS = ("محمد", "عبد", "العليم", "عمري", "العمر", "ابلغ", "اصبحت", "بدات", "بدأت", "ذهبت", "افكر")
#: Phrases that are no content; a parameter of the phrase filter.
ARABIC_PHRASES = (
    "السلام عليكم", "وعليكم السلام", "السلام عليكم ورحمة", "ورحمة الله وبركاته", "بسم الله الرحمن", "بسم الله الرحمن الرحيم", "في البداية أود", "البداية أود أشكركم", "شكرا لكم", "وشكرا لكم", "وشكرا جزيلا لكم", "جزاكم الله خيرا", "جزاكم الله خير",
    "جزاك الله خيرا", "جزاك الله خير", "جزيل الشكر", "ولكم جزيل الشكر", "جعله ميزان حسناتكم", "وجعله ميزان حسناتكم", "ميزان حسناتكم", "بارك الله فيكم", "عز وجل", "الحمد لله", "والحمد لله", "والله الحمد", "سليمه والحمد لله", "سليمه والله الحمد",
    "وكانت النتيجه سليمه", "الصلاة وقراءة القران", "قراءة القرآن", "ما تشخيصكم لحالتي", "ماذا تشخصكم لحالتي", "فما تشخيصكم لحالتي", "فما تشخصيكم لحالتي", "أرجو الرد", "أرجو الإفادة", "أفيدوني جزاكم الله", "لو سمحتم", "يا دكتور", "الى طبيب", "الي طبيب",
    "عمري سنة", "العمر سنة", "شاب بعمر سنة", "فتاة بعمر سنة", "شاب سنة", "فتاه سنة", "بعمر سنة", "نصف حبة", "حبة يوميا", "مرتين يوميا", "مرة يوميا",
)
#: Emoticons and punctuation that the Arabic block counts in the text as it is written.
ARABIC_EMOTICONS = r":-\)|:\)|:-\(|:\(|;-\)|;\)|:D|XD|<3|:'\(|:'\)|:-D"
ARABIC_EMOJIS = "[\\x{1F600}-\\x{1F64F}\\x{1F300}-\\x{1F5FF}\\x{1F680}-\\x{1F6FF}\\x{1F1E0}-\\x{1F1FF}\\x{2700}-\\x{27BF}\\x{24C2}-\\x{1F251}]+"
ARABIC_PUNCTUATION = "[،؟.!,:؛]"
