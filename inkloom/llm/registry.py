"""The subpackage's queries and their SQL."""

from __future__ import annotations

from inkloom.llm.decontaminate import op1_decontaminate_seeds
from inkloom.llm.html import op3_html_wrapper
from inkloom.llm.langid import op10_langid_kernel
from inkloom.llm.mpeg import op6_mpeg_audio
from inkloom.llm.neardup import op7_neardup_probminhash
from inkloom.llm.packing import op2_pack_hilbert
from inkloom.llm.pii import op9_pii_boosting
from inkloom.llm.quality import op4_quality_ftrl
from inkloom.llm.token_orc import op5_token_orc
from inkloom.llm.toxicity import op8_toxicity_counterfactual

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate_seeds,
        op2_pack_hilbert,
        op3_html_wrapper,
        op4_quality_ftrl,
        op5_token_orc,
        op6_mpeg_audio,
        op7_neardup_probminhash,
        op8_toxicity_counterfactual,
        op9_pii_boosting,
        op10_langid_kernel,
    )
}
ORACLES: dict[str, str] = {}
