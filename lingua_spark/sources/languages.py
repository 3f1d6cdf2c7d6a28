"""The language table: codes, size estimates and nested language sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language code, parallel-corpus code, code and estimated GB in
# the first web corpus, code and estimated GB in the second. English is not part
# of the second one, which has a data set of its own for it.
LANGUAGES = [
    # lang, flores_code, cc100_code, cc100_est_gb, fineweb_code, fineweb_est_gb
    ("en", "eng_Latn", "en", 82.0, None, 10000.0),
    ("de", "deu_Latn", "de", 18.0, "deu_Latn", 264.0),
    ("fr", "fra_Latn", "fr", 14.0, "fra_Latn", 188.0),
    ("es", "spa_Latn", "es", 14.0, "spa_Latn", 190.0),
    ("ru", "rus_Cyrl", "ru", 46.0, "rus_Cyrl", 404.0),
    ("pt", "por_Latn", "pt", 13.0, "por_Latn", 117.0),
    ("it", "ita_Latn", "it", 7.8, "ita_Latn", 80.0),
    ("pl", "pol_Latn", "pl", 12.0, "pol_Latn", 80.0),
    ("nl", "nld_Latn", "nl", 7.9, "nld_Latn", 60.0),
    ("zh", "cmn_Hans", "zh-Hans", 14.0, "cmn_Hani", 161.0),
    ("ja", "jpn_Jpan", "ja", 15.0, "jpn_Jpan", 121.0),
    ("ar", "arb_Arab", "ar", 5.4, "arb_Arab", 250.0),
    ("ko", "kor_Hang", "ko", 14.0, "kor_Hang", 30.0),
    ("id", "ind_Latn", "id", 3.6, "ind_Latn", 20.0),
    ("vi", "vie_Latn", "vi", 2.8, "vie_Latn", 28.0),
    ("tr", "tur_Latn", "tr", 5.4, "tur_Latn", 32.0),
    ("hi", "hin_Deva", "hi", 2.5, "hin_Deva", 16.0),
    ("fa", "fas_Arab", "fa", 2.0, "fas_Arab", 16.0),
    ("sw", "swh_Latn", "sw", 0.33, "swh_Latn", 1.6),
    ("el", "ell_Grek", "el", 7.4, "ell_Grek", 28.0),
    ("bn", "ben_Beng", "bn", 0.86, "ben_Beng", 61.0),
    ("th", "tha_Thai", "th", 8.7, "tha_Thai", 20.0),
    ("he", "heb_Hebr", "he", 6.1, "heb_Hebr", 13.7),
    ("yo", "yor_Latn", "yo", 0.011, "yor_Latn", 0.04),
    ("cy", "cym_Latn", "cy", 0.179, "cym_Latn", 0.2),
    ("ga", "gle_Latn", "ga", 0.108, "gle_Latn", 0.08),
    ("ku", "kmr_Latn", "ku", 0.09, "kmr_Latn", 0.08),
    ("mg", "plt_Latn", "mg", 0.029, "plt_Latn", 0.012),
    ("gn", "gug_Latn", "gn", 0.0015, "gug_Latn", 0.004),
    ("uk", "ukr_Cyrl", "uk", 1.4, "ukr_Cyrl", 28.0),
    ("ro", "ron_Latn", "ro", 1.6, "ron_Latn", 32.0),
    ("cs", "ces_Latn", "cs", 4.4, "ces_Latn", 40.0),
    ("hu", "hun_Latn", "hu", 1.5, "hun_Latn", 24.0),
    ("sv", "swe_Latn", "sv", 2.1, "swe_Latn", 40.0),
    ("fi", "fin_Latn", "fi", 1.5, "fin_Latn", 24.0),
    ("da", "dan_Latn", "da", 1.2, "dan_Latn", 20.0),
    ("no", "nob_Latn", "no", 1.3, "nob_Latn", 24.0),
    ("bg", "bul_Cyrl", "bg", 0.93, "bul_Cyrl", 105.0),
    ("hr", "hrv_Latn", "hr", 0.57, "hrv_Latn", 14.9),
    ("sr", "srp_Cyrl", "sr", 0.15, "srp_Cyrl", 16.1),
    ("sk", "slk_Latn", "sk", 0.61, "slk_Latn", 17.8),
    ("sl", "slv_Latn", "sl", 0.28, "slv_Latn", 10.9),
    ("lt", "lit_Latn", "lt", 0.34, "lit_Latn", 8.5),
    ("lv", "lvs_Latn", "lv", 0.21, "lvs_Latn", 4.8),
    ("et", "est_Latn", "et", 0.17, "ekk_Latn", 4.8),
    ("ur", "urd_Arab", "ur", 0.088, "urd_Arab", 1.8),
    ("ms", "zsm_Latn", "ms", 0.21, "zsm_Latn", 14.1),
    ("tl", "fil_Latn", "tl", 0.07, "fil_Latn", 0.8),
    ("ta", "tam_Taml", "ta", 0.13, "tam_Taml", 2.2),
    ("te", "tel_Telu", "te", 0.05, "tel_Telu", 0.9),
    ("kn", "kan_Knda", "kn", 0.036, "kan_Knda", 0.4),
    ("ml", "mal_Mlym", "ml", 0.083, "mal_Mlym", 1.3),
    ("mr", "mar_Deva", "mr", 0.033, "mar_Deva", 0.8),
    ("gu", "guj_Gujr", "gu", 0.024, "guj_Gujr", 0.6),
    ("pa", "pan_Guru", "pa", 0.009, "pan_Guru", 0.16),
    ("ha", "hau_Latn", "ha", 0.006, "hau_Latn", 0.08),
    ("so", "som_Latn", "so", 0.0078, "som_Latn", 0.08),
    ("zu", "zul_Latn", "zu", 0.004, "zul_Latn", 0.02),
    ("ig", "ibo_Latn", "ig", 0.006, "ibo_Latn", 0.012),
    ("am", "amh_Ethi", "am", 0.013, "amh_Ethi", 1.74),
    ("hy", "hye_Armn", "hy", 0.077, "hye_Armn", 1.6),
    ("ka", "kat_Geor", "ka", 0.11, "kat_Geor", 2.0),
    ("my", "mya_Mymr", "my", 0.046, "mya_Mymr", 0.4),
    ("km", "khm_Khmr", "km", 0.015, "khm_Khmr", 0.28),
    ("ne", "npi_Deva", "ne", 0.039, "npi_Deva", 0.8),
    ("si", "sin_Sinh", "si", 0.045, "sin_Sinh", 0.6),
    ("sq", "als_Latn", "sq", 0.13, "als_Latn", 35.0),
    ("az", "azj_Latn", "az", 0.13, "azj_Latn", 29.6),
    ("kk", "kaz_Cyrl", "kk", 0.088, "kaz_Cyrl", 1.6),
    ("uz", "uzn_Latn", "uz", 0.015, "uzn_Latn", 2.0),
    ("af", "afr_Latn", "af", 0.03, "afr_Latn", 8.1),
    ("mn", "khk_Cyrl", "mn", 0.039, "khk_Cyrl", 0.8),
    ("gl", "glg_Latn", "gl", 0.07, "glg_Latn", 2.0),
    ("eu", "eus_Latn", "eu", 0.048, "eus_Latn", 1.0),
    ("is", "isl_Latn", "is", 0.077, "isl_Latn", 2.0),
]
L20 = [
    "en", "zh", "es", "ar", "ru", "de", "fr", "ja", "hi", "pt",
    "id", "vi", "tr", "pl", "el", "sw", "fa", "bn", "th", "ko",
]
L60 = [
    "en", "zh", "es", "ar", "ru", "de", "fr", "ja", "hi", "pt",
    "id", "vi", "tr", "pl", "el", "sw", "fa", "bn", "th", "ko",
    "it", "nl", "uk", "ro", "cs", "hu", "sv", "fi", "da", "no",
    "he", "ms", "tl", "ta", "te", "mr", "ur", "gu", "pa", "kn",
    "ml", "ne", "si", "my", "km", "gn", "ga", "af", "ha", "so",
    "yo", "zu", "ig", "am", "az", "kk", "uz", "hy", "ka", "mn",
]
L100 = [
    "en", "zh", "es", "ar", "ru", "de", "fr", "ja", "hi", "pt",
    "id", "vi", "tr", "pl", "el", "sw", "fa", "bn", "th", "ko",
    "it", "nl", "uk", "ro", "cs", "hu", "sv", "fi", "da", "no",
    "he", "ms", "tl", "ta", "te", "mr", "ur", "gu", "pa", "kn",
    "ml", "ne", "si", "my", "km", "gn", "ga", "af", "ha", "so",
    "yo", "zu", "ig", "am", "az", "kk", "uz", "hy", "ka", "mn",
    "bg", "hr", "sr", "sk", "sl", "lt", "lv", "et", "sq", "gl",
    "eu", "is", "cy", "ku", "mg",
]
FINEWEB_ENGLISH = ("HuggingFaceFW/fineweb", None)
FINEWEB_OTHERS = "HuggingFaceFW/fineweb-2"
CC100 = "cc100"
# End of fixed values.

LANG_SETS = {"L20": L20, "L60": L60, "L100": L100}

SCHEMA = (
    "lang string, flores_code string, cc100_code string, cc100_est_gb double, "
    "fineweb_code string, fineweb_est_gb double"
)


def language_table(spark: SparkSession) -> DataFrame:
    """The 75 known languages; a literal relation, so always safe to broadcast."""
    return spark.createDataFrame(LANGUAGES, SCHEMA)


def lang_set_table(spark: SparkSession) -> DataFrame:
    rows = [(name, i, lang) for name, langs in LANG_SETS.items() for i, lang in enumerate(langs)]
    return spark.createDataFrame(rows, "lang_set string, position int, lang string")


def lang_set_members(spec: str) -> list[str]:
    """A named set or a comma list, in order; codes are not checked here."""
    if spec in LANG_SETS:
        return LANG_SETS[spec]
    return [code.strip() for code in spec.split(",") if code.strip()]


def filter_lang_set(df: DataFrame, spec: str, lang: str = "lang") -> DataFrame:
    """Rows in the known languages of the set: a pushed-down ``IN`` filter."""
    known = {row[0] for row in LANGUAGES}
    return df.filter(F.col(lang).isin([c for c in lang_set_members(spec) if c in known]))


def with_language(df: DataFrame, lang: str = "lang", known: bool = True) -> DataFrame:
    """Attach the language table; ``known=False`` gives the skipped rows instead."""
    table = F.broadcast(language_table(df.sparkSession).withColumnRenamed("lang", lang))
    return df.join(table, lang, "inner" if known else "left_anti")


def resolve_source(df: DataFrame, dataset: str = "fineweb", lang: str = "lang") -> DataFrame:
    """Dataset name and config each language is read from."""
    rows = with_language(df, lang)
    english = F.col(lang) == "en"
    if dataset == "cc100":
        name, config, size = F.lit(CC100), F.col("cc100_code"), F.col("cc100_est_gb")
    elif dataset == "fineweb":
        name = F.when(english, F.lit(FINEWEB_ENGLISH[0])).otherwise(F.lit(FINEWEB_OTHERS))
        config = F.when(~english, F.col("fineweb_code"))
        size = F.col("fineweb_est_gb")
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    return rows.select(*df.columns, name.alias("dataset"), config.alias("config"), size.alias("est_gb"))


def estimated_gb(dataset: str) -> Column:
    return F.col(f"{dataset}_est_gb")
