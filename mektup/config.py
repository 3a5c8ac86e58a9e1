"""Settings and fixed values shared by the whole package."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values. They must stay as they are for results to agree.
# ---------------------------------------------------------------------------

# Turkish stopwords removed by the cleaner.
STOPWORDS: tuple[str, ...] = (
    "ve", "ile", "bir", "bu", "şu", "o", "da", "de", "ki", "mi", "mu", "mü",
    "için", "gibi", "kadar", "daha", "çok", "az", "en", "hiç", "her",
    "bazı", "kendi", "onu", "ona", "ondan", "onun", "bize", "bizim", "siz",
    "sizin", "ben", "benim", "sen", "senin", "var", "yok", "olan", "oldu",
    "olacak", "olarak", "olsa", "olur", "olmak", "etmek", "etmiş", "etmişti",
    "gelmek", "gelen", "gelmiş", "gidecek", "gidiyor", "yapmak", "yapan",
    "yapılan", "yapılacak", "iki", "üç", "dört", "beş",
)

# Header names of the labelled CSV and the column names used here.
CSV_COLUMNS: dict[str, str] = {
    "Kategori": "category",
    "Başlık": "subject",
    "İçerik": "body",
    "Tarih": "created_at",
}

# Strings a CSV field may hold to mean "missing" (the pandas defaults).
NA_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Mail categories, in the order quotas are listed.
CATEGORIES: tuple[str, ...] = (
    "İş/Acil", "Güvenlik/Uyarı", "Pazarlama", "Sosyal Medya", "Spam",
    "Abonelik/Fatura", "Kişisel", "Eğitim/Öğretim", "Sağlık", "Diğer",
)

# Category pairs that get mixed up most often.
CONFUSABLE_PAIRS: tuple[tuple[str, str], ...] = (
    ("Sosyal Medya", "Güvenlik/Uyarı"),
    ("Kişisel", "İş/Acil"),
    ("Pazarlama", "Abonelik/Fatura"),
    ("Diğer", "Kişisel"),
    ("Eğitim/Öğretim", "Diğer"),
    ("Güvenlik/Uyarı", "İş/Acil"),
    ("Abonelik/Fatura", "Pazarlama"),
    ("Kişisel", "Diğer"),
    ("Sağlık", "Diğer"),
    ("Spam", "Pazarlama"),
)

# Words a mail of a category should hold ("include") or must not hold ("avoid").
CATEGORY_HINTS: dict[str, dict[str, tuple[str, ...]]] = {
    "Sosyal Medya": {
        "include": ("instagram", "linkedin", "facebook", "tiktok", "twitter", "x", "beğeni",
                    "yorum", "takip", "mesaj", "bildirim", "etkileşim", "hikaye"),
        "avoid": ("şifre", "doğrulama", "güvenlik", "şüpheli giriş", "hesabınız", "otp", "kod",
                  "oturum", "kilitlendi", "kimlik doğrulama"),
    },
    "Güvenlik/Uyarı": {
        "include": ("şüpheli", "giriş", "doğrulama", "şifre", "güvenlik", "kod", "otp",
                    "hesabınız", "oturum", "kilit", "koruma"),
        "avoid": ("takip etti", "beğendi", "yorum yaptı", "instagram", "linkedin", "facebook",
                  "tiktok", "kampanya", "indirim", "kupon"),
    },
    "Pazarlama": {
        "include": ("kampanya", "indirim", "fırsat", "kupon", "sepette", "son gün", "%",
                    "hediye", "çek"),
        "avoid": ("fatura", "ödeme", "abonelik", "yenileme", "tahsilat", "son ödeme", "dekont",
                  "tutar"),
    },
    "Abonelik/Fatura": {
        "include": ("fatura", "ödeme", "abonelik", "yenileme", "tutar", "son ödeme", "işlem",
                    "dekont"),
        "avoid": ("kupon", "kampanya", "flash sale", "kaçırma", "sepete ekle", "hediye çek"),
    },
    "Kişisel": {
        "include": ("nasılsın", "görüşürüz", "özledim", "selam", "akşam", "hafta sonu",
                    "buluşalım"),
        "avoid": ("toplantı", "deadline", "müşteri", "rapor", "proje", "acil görev",
                  "saygılarımla"),
    },
    "İş/Acil": {
        "include": ("toplantı", "acil", "proje", "müşteri", "rapor", "deadline", "aksiyon",
                    "güncelleme"),
        "avoid": ("özledim", "buluşalım", "canım", "hadi", "hafta sonu", "kanka"),
    },
    "Eğitim/Öğretim": {
        "include": ("ödev", "sınav", "ders", "not", "program", "kayıt", "öğrenci", "öğretmen",
                    "akademik"),
        "avoid": ("kampanya", "kupon", "satın al", "sepete", "indirim"),
    },
    "Sağlık": {
        "include": ("randevu", "muayene", "test sonucu", "tetkik", "doktor", "hastane", "reçete",
                    "tahlil"),
        "avoid": ("kampanya", "kupon", "takip etti", "beğendi", "fatura numarası"),
    },
    "Spam": {
        "include": ("kazandınız", "hemen tıkla", "acil", "son uyarı", "bedava", "ödül", "şanslı"),
        "avoid": ("saygılarımla", "resmi", "dekont", "randevu onayı"),
    },
    "Diğer": {
        "include": ("etkinlik", "duyuru", "hobi", "bülten", "gönüllü", "topluluk", "atölye",
                    "kulüp"),
        "avoid": ("ödev", "sınav", "fatura", "ödeme", "kupon", "kampanya", "şifre sıfırla"),
    },
}

# Markers of the block-text format and of a body's continuation end.
SUBJECT_MARK = "Başlık"
BODY_MARK = "İçerik"
CATEGORY_MARK = "Kategori"

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Config:
    """Hyper-parameters of cleaning, vectorising, training and data collection."""

    # cleaning
    stopwords: tuple[str, ...] = STOPWORDS
    remove_stopwords: bool = True
    min_word_length: int = 3
    turkish_lowercase: bool = True
    min_words: int = 3
    keep_empty: bool = False
    # TF-IDF
    word_ngrams: tuple[int, int] = (1, 3)
    char_ngrams: tuple[int, int] = (3, 5)
    word_features: int = 12_000
    char_features: int = 8_000
    min_df: float = 2
    max_df: float = 0.95
    sublinear_tf: bool = True
    # training
    test_share: float = 0.2
    seed: int = 42
    nb_alpha: float = 0.1
    lr_iterations: int = 300
    tolerance: float = 1e-4
    svm_iterations: int = 1000
    calibration_folds: int = 3
    gbt_rounds: int = 50
    gbt_depth: int = 5
    gbt_bins: int = 8
    # collection targets
    quota_min: int = 2000
    quota_max: int = 2000
    batch_size: int = 100
    # scoring
    fallback_label: str = "Diğer"
