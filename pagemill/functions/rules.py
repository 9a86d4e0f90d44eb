"""Rule rows: ordered corrections and review patterns, each active with a profile."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple


class Correction(NamedTuple):
    profile: str
    name: str
    pattern: str
    replacement: str


class Review(NamedTuple):
    profile: str
    reason: str
    pattern: str


DEFAULT_PROFILES = ("common",)
#: What a profile brings with it.
NEEDS = {"rag-accuracy-book": ("common", "ai-rag"), "ai-rag": ("common",)}

# Corrections in order, and patterns for review during and after recognition. (?U) as in functions.text.
CORRECTIONS = (
    Correction("ai-rag", "LIM -> LLM", r"(?<![A-Za-z0-9])LIM(?![A-Za-z0-9])", "LLM"),
    Correction("ai-rag", "LILM -> LLM", r"(?<![A-Za-z0-9])LILM(?![A-Za-z0-9])", "LLM"),
    Correction("ai-rag", "UM -> LLM (before を評価者)", r"(?U)(?<![A-Za-z0-9])UM(?=\s*を評価者)", "LLM"),
    Correction("ai-rag", "LLMLas-a-Judge -> LLM-as-a-Judge", r"(?<![A-Za-z0-9])LLMLas-a-Judge(?![A-Za-z0-9])", "LLM-as-a-Judge"),
    Correction("ai-rag", "LM -> LLM (LLM context)", r"(?U)(?<![A-Za-z0-9])LM(?=\s*(?:で回答|に渡す))", "LLM"),
    Correction("ai-rag", "Al -> AI (before LLM)", r"(?U)(?<![A-Za-z0-9])Al(?=\s*[・/]\s*LLM(?![A-Za-z0-9]))", "AI"),
    Correction("ai-rag", "Al -> AI (after 生成)", r"(?<=生成 )Al(?![A-Za-z0-9])", "AI"),
    Correction("ai-rag", "Al -> AI (AI context)", r"(?U)(?<![A-Za-z0-9])Al(?=\s*(?:に|の|を|が|は|へ|で|と)?\s*(?:検索|サービス|エージェント|スタートアップ|分野|モデル|技術|システム))", "AI"),
    Correction("ai-rag", "AL -> AI (before 分野)", r"(?U)(?<![A-Za-z0-9])AL(?=\s*分野)", "AI"),
    Correction("ai-rag", "OpenAl/OpenAT -> OpenAI", r"(?<![A-Za-z0-9])OpenA[lT](?![A-Za-z0-9])", "OpenAI"),
    Correction("common", "ユュユーザー -> ユーザー", r"ユュユーザー", "ユーザー"),
    Correction("ai-rag", "DeepSerach -> DeepSearch", r"(?U)\bDeepSerach\b", "DeepSearch"),
    Correction("common", "りリリース -> リリース", r"りリリース", "リリース"),
    Correction("common", "ュユーザー -> ユーザー", r"ュユーザー", "ユーザー"),
    Correction("common", "ユュースケース -> ユースケース", r"ユュースケース", "ユースケース"),
    Correction("common", "ユューザー -> ユーザー", r"ユューザー", "ユーザー"),
    Correction("ai-rag", "J udge -> Judge", r"(?U)(?<![A-Za-z])J\s+udge\b", "Judge"),
    Correction("ai-rag", "クニエリ -> クエリ", r"クニエリ", "クエリ"),
    Correction("ai-rag", "チャンジンク -> チャンク", r"チャンジンク", "チャンク"),
    Correction("ai-rag", "親チャンクノン親ドキュメント -> 親チャンク／親ドキュメント", r"親チャンクノン親ドキュメント", "親チャンク／親ドキュメント"),
    Correction("ai-rag", "親ページプン親チャンク -> 親ページ／親チャンク", r"親ページプン親チャンク", "親ページ／親チャンク"),
)
LINE_REVIEWS = (
    Review("common", "mixed_script_ending", r"(?U)[ぁ-んァ-ヶ一-龯]\s+[A-Z]{1,3}[,.:;]?$"),
    Review("ai-rag", "embedded_ai_rag_noise", r"クニエリ|チャンジンク|親チャンクノン|親ページプン"),
    Review("common", "ocr_symbol_fragment", r"\[(?:=|[A-Za-z]{1,3})\]"),
    Review("rag-accuracy-book", "repeated_book_kana", r"じてでて|まずすず|すず"),
    Review("rag-accuracy-book", "embedded_book_ocr_noise", r"(?U)比較レ|レポー\s*\d|HIE\s+RAG|宮崎験|WET,|To ARAL|AELOET"),
)
PAGE_REVIEWS = (
    Review("ai-rag", "llm_variant_lilm", r"(?<![A-Za-z0-9])LILM(?![A-Za-z0-9])"),
    Review("ai-rag", "llm_variant_um", r"(?U)(?<![A-Za-z0-9])UM(?=\s*を評価者)"),
    Review("ai-rag", "llm_variant_title", r"(?U)\bLLMLas-a-Judge\b"),
    Review("ai-rag", "llm_variant_lm", r"(?U)(?<![A-Za-z0-9])LM(?=\s*(?:で回答|に渡す))"),
    Review("common", "checkbox_fragment", r"\[(?:=|[A-Za-z]{1,3})\]"),
    Review("ai-rag", "joined_heading", r"Self-RAGLLM"),
    Review("rag-accuracy-book", "confirmed_book_ocr_error", r"(?U)じてでて|まずすず|AELOET|比較レて|来てまずよ|HIE\s*RAG|中み出|To ARAL|=ークリッド|宮崎験|WET,|いっ\s*つた|ソツール|場合なあります|人歓迎|ユューザー|根拠に思実|やすぐ|マルチモーダレル|画像トナ|ブフォーマシト"),
    Review("rag-accuracy-book", "reading_order", r"す。[「『]構造化"),
)


def expand_profiles(profiles: Iterable[str] | None) -> frozenset[str]:
    """Profiles with what they need; None is the default, an empty list is none."""
    found = list(DEFAULT_PROFILES if profiles is None else profiles)
    for p in found:
        found += [x for x in NEEDS.get(p, ()) if x not in found]
    return frozenset(found)


def active(rules: Iterable[Correction] | Iterable[Review], profiles: Iterable[str] | None) -> list:
    own = expand_profiles(profiles)
    return [r for r in rules if r.profile in own]
