"""Corrections that hold for one title only, as rows for its profile. Nothing uses them unless the profile is asked for."""

from __future__ import annotations

from typing import NamedTuple

from pagemill.functions.rules import Correction

PROFILE = "rag-accuracy-book"


class Context(NamedTuple):
    """A repair that depends on the lines before and after, as recognised: where all three patterns are found, `text` is
    replaced ({prev} is the line before, {text} the line itself), or the line removed if replacement is None."""

    name: str
    prev: str
    text: str
    next: str
    replacement: str | None


# Ordered corrections of the title.
BOOK_CORRECTIONS = tuple(
    Correction(PROFILE, *row)
    for row in (
        ("HIE RAG -> 第3章 RAG", r"(?U)(?<![A-Za-z])HIE(?=\s*RAG\s*精度改善)", "第3章"),
        ("宮崎験 -> 宮崎駿", r"宮崎験", "宮崎駿"),
        ("宮崎駿一 (会社 -> 宮崎駿 — (会社", r"(?U)宮崎駿一(?=\s*\(会社)", "宮崎駿 —"),
        ("numbered-list underscore -> removed", r"(?U)(?<=\d\.)\s*_\s*(?=前処理)", " "),
        ("_ LanceDB -> LanceDB", r"(?U)(?<![A-Za-z])_\s+(?=LanceDB\b)", ""),
        ("Hallucination) J -> Hallucination)」", r"(?U)Hallucination\)\s*J", "Hallucination)」"),
        ("説明 ET, -> 説明します。", r"(?U)説明\s+ET,", "説明します。"),
        ("構成されま i : -> 構成されます：", r"(?U)構成されま\s+i\s*[:：]", "構成されます："),
        ("です。 HF -> です。研", r"(?U)です。\s*HF\b", "です。研"),
        ("完レポート -> 究レポート", r"完レポート", "究レポート"),
        ("整理じてでておりまずすず -> 整理しております", r"(?U)^整理じてでておりまずすず\s*[:：]", "整理しております："),
        ("じてでておりまずすず -> しております", r"(?U)^じてでておりまずすず\s*[:：]", "しております："),
        ("retrieval chapter sentence recovery", r"(?U)^AELOET,\s*EL,\s*FOFEY\s+THEE\]\s*TRH\s+ERA,\s*データの", "をまとめます。ただし、どの手法も「万能」ではありません。データの"),
        ("来てまずよ/という ? う形 -> 来てますよ/という形", r"(?U)来てまずよ」どという\s*\?\s*う形", "来てますよ」という形"),
        ("本書の最初の草 -> 本書の最初の章", r"本書の最初の草", "本書の最初の章"),
        ("徹し込む -> 流し込む", r"徹し込む", "流し込む"),
        ("クエリに登場しレた -> クエリに登場した", r"クエリに登場しレた", "クエリに登場した"),
        ("ノフード間 -> ノード間", r"ノフード間", "ノード間"),
        ("精統化 -> 精緻化", r"精統化", "精緻化"),
        ("流輸さ -> 流暢さ", r"流輸さ", "流暢さ"),
        ("モニタリンググ基盤 -> モニタリング基盤", r"モニタリンググ基盤", "モニタリング基盤"),
        ("マッピングレし -> マッピングし", r"マッピングレし", "マッピングし"),
        ("検索記/刀推論 -> 検索&推論", r"検索[記刀]推論", "検索&推論"),
        ("翼境 -> 環境", r"翼境", "環境"),
        ("ソツール -> ツール", r"ソツール", "ツール"),
        ("場合なあります -> 場合があります", r"場合なあります", "場合があります"),
        ("人歓迎します -> 歓迎します", r"人歓迎します", "歓迎します"),
        ("精度改番 -> 精度改善", r"精度改番", "精度改善"),
        ("根拠に思実か -> 根拠に忠実か", r"根拠に思実か", "根拠に忠実か"),
        ("下がりやすぐ -> 下がりやすく", r"下がりやすぐ", "下がりやすく"),
        ("マルチモーダレル -> マルチモーダル", r"マルチモーダレル", "マルチモーダル"),
        ("画像トナテキスト -> 画像やテキスト", r"画像トナテキスト", "画像やテキスト"),
        ("物在のよりモダン -> 現在のよりモダン", r"物在のよりモダン", "現在のよりモダン"),
        ("ブフォーマシト -> フォーマット", r"ブフォーマシト", "フォーマット"),
        ("いっつた -> いった", r"(?U)いっ\s*つた", "いった"),
        ("比較レて -> 比較して", r"比較レて", "比較して"),
        ("BELベル -> 段落レベル", r"BELベル", "段落レベル"),
        ("元の文書き。 -> 元の文書や、", r"元の文書き。", "元の文書や、"),
    )
)
# Repairs across lines of the title, in order. A line that is removed under a name counts as a correction.
BOOK_CONTEXT = tuple(
    Context(*row)
    for row in (
        ("", r"構成されま\z", r"(?U)^i\s*[:：]\z", "", None),
        ("", "", r"^\(人名、組織、場所、出来事", r"^e ノード:", None),
        ("", "", r"^す。\z", r"^「構造化された関係性」", None),
        ("split 構成されま/i : -> 構成されます：", "", r"(?<=構成されま)\z", r"(?U)^i\s*[:：]\z", "す："),
        ("一歩を中/み出す -> 一歩を踏み出す", "", r"(?<=一歩を)中\z", r"^み出したい", ""),
        ("中/み出したい -> 踏み出したい", r"一歩を中\z", r"^(?=み出したい)", "", "踏"),
        ("なりま/To ARAL -> なります。生成 AI", "", r"(?<=なりま)\z", r"^To ARAL のブラックボックス性", "す。"),
        ("To ARAL の -> 生成 AI の", r"なりま\z", r"^To ARAL の(?=ブラックボックス性)", "", "生成 AI の"),
        ("定番で/Te -> 定番です。", "", r"(?<=定番で)\z", r"^Te\z", "す。"),
        ("Te after 定番で -> removed", r"定番で\z", r"^Te\z", "", None),
        ("=/ークリッド -> ユークリッド", "", r"(?<=と )=\z", r"^ークリッド距離", "ユ"),
        ("提案して/WET, -> 提案しています。", r"提案して\z", r"^WET,\z", "", "います。"),
        ("向いて/WET, -> 向いています。", r"向いて\z", r"^WET,\z", "", "います。"),
        ("下がり/やすぐ -> 下がりやすく", r"下がり\z", r"^やすぐ", "", "やすく"),
        ("ジ -> ン (after パイプライ)", r"パイプライ\z", r"^ジ(?=です)", "", "ン"),
        ("とい/っつた -> といった", r"とい\z", r"^っつた(?=自動スコア)", "", "った"),
        ("node detail before label -> label before node detail", r"^\(人名、組織、場所、出来事", r"(?s)^(e ノード:.*)\z", "", "{text} {prev}"),
        ("misordered sentence end -> sentence end", r"^す。\z", r"(?s)^(「構造化された関係性」.*特徴で)\z", "", "{text}す。"),
        ("BEL/ベル -> 段落レベル", "", r"BEL\z", r"^ベルや", "段落レ"),
        ("比較レ/て -> 比較して", "", r"比較レ\z", r"^て、", "比較し"),
        ("来てま/ずよどという ? う形 -> 来てますよという形", r"来てま\z", r"(?U)^ずよ」どという\s*\?\s*う形", "", "すよ」という形"),
        ("すず : -> す： (after イメージで)", r"イメージで\z", r"(?U)^すず?\s*[:：]\z", "", "す："),
        ("パイプライ -> パイプライン (missing continuation)", "", r"(?<=パイプライ)\z", r"^(?!ジです|ンです)", "ン"),
        ("section heading -> section heading：", "", r"(?U)^\d+(?:\.\d+){2}\s+(?:Self-RAG|Agentic RAG|RAG-Reasoning)\z", "", "{text}："),
    )
)
