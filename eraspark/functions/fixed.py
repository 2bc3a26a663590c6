"""Fixed values.

These must equal the values the analysed project uses, so they are stated
plainly, in their natural order, in one place. Everything else in the library
is derived from them or passed in as a parameter.
"""

# --- fixed values: corpus filtering ------------------------------------------
# Title keywords that mark a non-original song (substring match, lower case).
NOISE_KEYWORDS = (
    "google translate", "translate", "google", "edition",
    "how to translate", "cover", "karaoke", "instrumental",
)
KEEP_LANGUAGE = "en"
MIN_CLEAN_CHARS = 20          # keep when char_length(clean) > 20
YEAR_MIN, YEAR_MAX = 1970, 2025

# --- fixed values: era bins (left-closed) ------------------------------------
ERA_EDGES = (1970, 1980, 1990, 2000, 2010, 2020, 2026)
ERA_LABELS = ("1970s", "1980s", "1990s", "2000s", "2010s", "2020s")

# --- fixed values: genres -----------------------------------------------------
GENRES = ("country", "pop", "rap", "rb", "rock")
EXCLUDED_GENRE = "misc"

# --- fixed values: sampling caps ----------------------------------------------
CLASS_CAP = 20_000            # undersampling, rows per era
OVR_NEGATIVE_CAP = 200_000    # one-vs-rest negatives per target era
SPLIT_TEST_FRACTION = 0.10    # test = ceil(0.1 n); val = ceil(0.1 rest)
SEED = 42
GENRE_DRAWS_PER_CLASS = 10_000  # with-replacement draws per side per genre
VERIFY_SAMPLE_N = 50            # rows drawn for the manual year check
REPORT_SAMPLE_N = 1_000         # rows drawn for the method comparison

# --- fixed values: TF-IDF jobs (max features, min df) ---------------------------
TOP_TOKENS_V, TOP_TOKENS_MIN_DF, TOP_TOKENS_K = 80_000, 3, 100
OVR_ERA_V = 50_000
MLP_V = 50_000
PER_ERA_V = 80_000
MULTICLASS_V = 120_000
RIDGE_V = 120_000
GENRE_BINARY_V = 150_000
GENRE_BALANCED_V = 500_000

# --- fixed values: ensemble ------------------------------------------------------
ENSEMBLE_WEIGHT_A, ENSEMBLE_WEIGHT_B = 0.6, 0.4

# --- fixed values: lyric record (ingest) ---------------------------------------
RECORD_FIELDS = (
    "id", "platform", "platform_type", "url", "content_type",
    "timestamp", "scraper_module",
    "song_title", "artist", "album", "release_year",
    "genre", "language_variant",
    "text", "raw_text",
    "scrape_date",
)
PLATFORMS = ("musicatm", "sanookmusic", "youtube", "deezer", "spotify")
PLATFORM_TYPES = ("lyrics-site", "streaming", "fan-archive")
CONTENT_TYPES = ("lyrics", "metadata", "both")
RECORD_DEFAULTS = {
    "platform": "musicatm",
    "platform_type": "lyrics-site",
    "content_type": "lyrics",
    "language_variant": "Thai",
}
# Fields trimmed by the record normaliser.
RECORD_TRIMMED = ("id", "platform", "platform_type", "url", "content_type",
                  "song_title", "artist", "language_variant")
DATETIME_FORMAT = "yyyy-MM-dd HH:mm:ss"   # Python "%Y-%m-%d %H:%M:%S"

# --- fixed values: crawl ----------------------------------------------------------
LYRICS_PLACEHOLDER_TITLE = "เนื้อเพลง"      # the word "lyrics": not a real title
ARTIST_HREF_PREFIX = "/ศิลปิน/"             # artist links on the index page
SONG_TITLE_PREFIX = "เนื้อเพลง"              # song links: title attribute prefix
LYRICS_BLOCK_ID = "lyric-lyric"             # container of the lyric text
GENRE_LABEL_MARKER = "หมวดเพลง"              # "song category" label
SEARCH_YEAR_KEYWORD = "ปี"                  # "year", appended to year searches
INDEX_PATH = "/หาศิลปิน/"                    # one index page a letter
LYRICS_SEARCH_URL = "https://www.lyricsfreak.com/search.php?a=search&type=song&q="
YEAR_SEARCH_URL = "https://duckduckgo.com/html/?q="
CHECK_SEARCH_URL = "https://www.google.com/search?q="
CHECK_YEAR_KEYWORDS = "เพลง ปี ออกปี"        # "song year released-year"
RESULT_LINK_CLASS = "song"                  # search results: class of a hit's link
THAI_INDEX_LETTERS = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรฤลฦวศษสหฬอฮ"

# --- fixed values: prediction payload keys (first usable key wins) -----------
ERA_KEYS = ("era", "predicted_era", "predictedEra", "era_label")
GENRE_KEYS = ("genre", "predicted_genre", "predictedGenre", "genre_label")
ERA_CONFIDENCE_KEYS = ("era_confidence", "eraConfidence", "era_score")
GENRE_CONFIDENCE_KEYS = ("genre_confidence", "genreConfidence", "genre_score")
OVERALL_CONFIDENCE_KEYS = ("overall_confidence", "overallConfidence", "confidence")
DEFAULT_ERA, DEFAULT_GENRE = "Unknown era", "Unknown genre"

# --- fixed values: crawler record constants --------------------------------------
CRAWL_PLATFORM = "meemodel"
CRAWL_PLATFORM_TYPE = "lyrics-site"
CRAWL_CONTENT_TYPE = "lyrics"
CRAWL_LANGUAGE_VARIANT = "Central Thai text"
CRAWL_SCRAPER_MODULE = "meemodel_scraper.py"
TOKEN_MAX_LEN = 256           # padded/truncated id length
YEAR_TOKEN_MAX_LEN = 512      # that of the year model

# --- fixed values: release-year extraction ---------------------------------------
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
BUDDHIST_ERA_OFFSET = 543
YEAR_BY_ARTIST_WORD = "เพลงโดย"             # "song by"
YEAR_VIA_WORD = "ทาง"                       # "via"
YEAR_RELEASE_KEYWORDS = ("release", "วางจำหน่าย", "Apple Music")  # priority order
YEAR_SNIPPET_CHARS = 20
YEAR_MIN_PLAUSIBLE = 1950

# --- fixed values: stop words ------------------------------------------------------
# Default English stop list: the list Spark ML ships
# (StopWordsRemover.loadDefaultStopWords("english")), in its own order.
# Pass ``stop_words=`` to any tokenising operator to use another list.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she",
    "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of",
    "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how",
    "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's",
    "we're", "they're", "i've", "we've", "you've", "they've", "isn't",
    "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't",
    "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't",
    "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's",
    "let's", "ought", "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", "would",
)
