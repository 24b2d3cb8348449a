"""The registered corpus queries and their SQL."""

from .op1_neardup import op1_neardup
from .op2_html import op2_html
from .op3_media import op3_media
from .op4_pieces import op4_sentencepiece
from .op5_urls import OP5_SQL, op5_urls
from .op6_repeats import OP6_SQL, op6_repeats
from .op7_mix import OP7_SQL, op7_mix
from .op8_quality import OP8_SQL, op8_quality
from .op9_language import op9_language
from .op10_license import OP10_SQL, op10_license

QUERIES = {f.__name__: f for f in (op1_neardup, op2_html, op3_media, op4_sentencepiece, op5_urls, op6_repeats, op7_mix, op8_quality, op9_language, op10_license)}
SQL = {"op5_urls": OP5_SQL, "op6_repeats": OP6_SQL, "op7_mix": OP7_SQL, "op8_quality": OP8_SQL, "op10_license": OP10_SQL}
