"""Reference dictionaries, as plain values."""

# Languages with their names and codes for the translation services.
LANGUAGE_NAMES = {
    "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "en": "English", "vi": "Vietnamese", "th": "Thai",
    "id": "Indonesian", "fr": "French", "de": "German", "es": "Spanish", "ru": "Russian",
}
NLLB_CODES = {
    "ja": "jpn_Jpan", "en": "eng_Latn", "vi": "vie_Latn", "zh": "zho_Hans", "ko": "kor_Hang", "th": "tha_Thai",
    "id": "ind_Latn", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn", "ru": "rus_Cyrl",
}
BAIDU_CODES = {"ja": "jp", "zh": "zh", "ko": "kor", "en": "en", "vi": "vie"}

# Words too common to be terms.
STOP_WORDS_JA = "は が を に の で と も や か から まで より など だ です ます".split()
STOP_WORDS_KO = "은 는 이 가 을 를 의 에 와 과 도 만 부터 까지 에서 로 으로".split()
STOP_WORDS_ZH = "的 了 是 在 有 和 与 或 但 而 就 也 都 要 会 能 可以".split()

# Endings that mark a name, by language.
HONORIFICS_JA = "さん 君 くん ちゃん 様 さま 先生 先輩 後輩 殿".split()
HONORIFICS_KO = "씨 님 선배 후배 형 누나 오빠 언니".split()
TITLES_ZH = "先生 小姐 大人 师父 师兄 师姐".split()

# Form choices and what they stand for.
TRANSLATORS = {"Opus-mt model": "hf", "NLLB": "nllb", "Gemini": "gemini", "Local LLM": "copilot"}
SOURCES = {"japanese (manga)": "ja", "chinese (manhua)": "zh", "korean (manhwa)": "ko", "english (comic)": "en"}
TARGETS = {
    "english": "en", "vietnamese": "vi", "chinese": "zh", "korean": "ko", "thai": "th",
    "indonesian": "id", "french": "fr", "german": "de", "spanish": "es", "russian": "ru",
}
STYLES = {
    "default": "", "casual (thân mật)": "casual", "formal (trang trọng)": "formal", "keep honorifics (-san, senpai...)": "keep_honorifics",
    "web novel style": "web_novel", "action (ngắn gọn)": "action", "literal (sát nghĩa)": "literal", "custom...": "",
}

# Fonts in the order in which a loose answer is matched.
FONTS = (
    "animeace_", "mangat", "arial", "Yuki-Arenzi", "Yuki-Burobu", "Yuki-CCMarianChurchlandJournal", "Yuki-CDX Starstreak", "Yuki-CHICKEN Pie",
    "Yuki-CrashLanding BB", "Yuki-Downhill Dive", "Yuki-Gingerline DEMO Regular", "Yuki-Gorrilaz_Story", "Yuki-KG Only Angel", "Yuki-LF SwandsHand",
    "Yuki-La Belle Aurore", "Yuki-Little Cupcakes", "Yuki-Nagurigaki Crayon", "Yuki-Ripsnort BB", "Yuki-Roasthink", "Yuki-Screwball",
    "Yuki-Shark Crash", "Yuki-Skulduggery", "Yuki-Superscratchy", "Yuki-Tea And Oranges Regular",
)
DEFAULT_FONT = "animeace_"
ANSWER_PREFIXES = ("The best matching font is ", "Best match: ", "Font: ", "I recommend ")

#: Instructions of the preset styles, in our words.
STYLE_PRESETS = {
    "default": "", "formal": "Keep a formal and polite register.", "casual": "Keep an everyday, conversational register.",
    "keep_honorifics": "Leave honorific suffixes as they are.", "localize": "Adapt idioms and cultural references to the reader.",
    "literal": "Stay close to the meaning, in speakable sentences.", "web_novel": "Write with the drama of serial fiction.", "action": "Write short sentences at a quick pace.",
}

# Titles and frame of the context that a prompt carries.
CONTEXT_OPEN = "---\nCONTEXT MEMORY:\n"
CONTEXT_NAMES = "CHARACTER NAMES (use consistently):\n"
CONTEXT_TERMS = "KEY TERMS (translate consistently):\n"
CONTEXT_STORY = "STORY SO FAR:\n  "
CONTEXT_CLOSE = "---\n"

# Options of a job that a form leaves out.
DEFAULT_TARGET = "vi"
DEFAULT_OCR = "chrome-lens"
DEFAULT_SERVER = "http://localhost:8080"
DEFAULT_MODEL = "gpt-4o"
