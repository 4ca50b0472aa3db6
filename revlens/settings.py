"""Fixed values and job options."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values. Results depend on them, so they are stated as plain text.
# ---------------------------------------------------------------------------

LABEL_CODES = {"Negatif": 0, "Positif": 1}
NEUTRAL_LABEL = "Netral"

TEXT_COLUMNS = ("perbaikan", "textTranslated", "text")

BAD_TEXTS = ("", "x", "-", ".", "n/a", "na", "none", "null")

TOKEN_PATTERN = "[a-zA-ZÀ-ÿ]+(?:[-'][a-zA-ZÀ-ÿ]+)?"

# The 29 characters that count as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

GENERAL_STOPWORDS = tuple(
    """
    ada adalah agar akan aku anda apa atau bagaimana bagi bagian bahwa baik
    banyak baru begitu belum benar berapa berada berbagai beri berikut bersama
    bisa buat cukup dalam dan dapat dari daripada dengan di dia dibanding
    diberikan diri dulu hingga ia ini itu jadi juga kalau kami kan karena ke
    kembali kemudian kepada ketika lagi lebih maka makanan makin masih melalui
    memang mereka menu meski minuman mungkin namun oleh pada para pasti pernah
    perlu saat saja saling sama sambil sampai sangat saya sebagai sebaiknya
    sebelum sebelumnya sebuah secara sedang sedikit sehingga sejak sekali
    sekitar selain selama seluruh semua sendiri seperti serta setelah
    setidaknya setiap sudah supaya tadi tanpa tapi telah tempat tentang tentu
    terasa terdapat tergolong tersebut tetapi the to untuk yang
    """.split()
)

DOMAIN_STOPWORDS = tuple(
    "gandaria city gc green ikuya ikuyo matcha matchanya matchaya milk tea".split()
)

STOPWORDS = tuple(dict.fromkeys(GENERAL_STOPWORDS + DOMAIN_STOPWORDS))

KEYWORD_SEEDS = tuple(
    """
    enak lezat nikmat nyaman ramah bagus terbaik mantap autentik
    direkomendasikan murah mahal harga harganya buruk kecewa lama antrean
    menunggu kurang tidak biasa pahit manis
    """.split()
)

BLANK_TEXT_MESSAGE = "Masukkan teks review."
NO_MODEL_MESSAGE = "Model belum tersedia."

FEATURES = ("tfidf", "word2vec")
MODELS = (
    "logistic_regression",
    "linear_svm",
    "random_forest",
    "extra_trees",
    "gradient_boosting",
)

# ---------------------------------------------------------------------------
# Options
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TfidfOptions:
    max_features: int = 12000
    min_df: int = 2


@dataclass(frozen=True)
class Word2VecOptions:
    vector_size: int = 150
    window: int = 5
    min_count: int = 1
    epochs: int = 60
    negative: int = 5
    # Of the first step; it falls to nothing over the epochs.
    rate: float = 0.25
    # Passes over two ranges of words when they meet; fewer mix the ranges more
    # often, and cost more rounds.
    passes: int = 10
    # Ranges of words, at least; tasks that train side by side. The vectors depend
    # on it, but not on the cluster.
    partitions: int = 8
    # A range has at most so many words, and two ranges about so many pairs.
    range_words: int = 65_536
    range_pairs: int = 4_000_000
    # A table of vectors up to this size is broadcast for pooling; a larger one is
    # joined with the tokens.
    broadcast_bytes: int = 128 << 20


@dataclass(frozen=True)
class TreeOptions:
    forest_trees: int = 450
    extra_trees: int = 500
    boosting_rounds: int = 100
    # None: until the leaves are pure or small.
    max_depth: int | None = None
    min_leaf: int = 2


@dataclass(frozen=True)
class CompareOptions:
    folds: int = 10
    seed: int = 42
    features: tuple[str, ...] = FEATURES
    models: tuple[str, ...] = MODELS
    linear_iterations: int = 2500
    # Of the linear SVM; None is the number above.
    svm_iterations: int | None = 1000
    # Fits submitted at the same time by the driver.
    parallel_fits: int = 4
    stop_on_error: bool = False
    tfidf: TfidfOptions = field(default_factory=TfidfOptions)
    word2vec: Word2VecOptions = field(default_factory=Word2VecOptions)
    trees: TreeOptions = field(default_factory=TreeOptions)
    stopwords: tuple[str, ...] = STOPWORDS
    seeds: tuple[str, ...] = KEYWORD_SEEDS
