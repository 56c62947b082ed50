"""The queries restated in SQL for a second engine.

Where an input is generated by a formula the expected result is written out from the words
of the document; real pages are read with plain string functions. Neither follows the way
the Spark side computes its result.
"""

from foliomill.oracle.html import HTML
from foliomill.oracle.markdown import MARKDOWN
from foliomill.oracle.scalars import SCALARS
from foliomill.oracle.tree import TREE

ORACLE: dict[str, str] = {**SCALARS, **HTML, **TREE, **MARKDOWN}
