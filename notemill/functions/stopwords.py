"""The default stop-word list; every operator takes another one as a parameter."""

from __future__ import annotations

# English words that carry no topic.
ENGLISH = """
a about above after again against all almost alone along already also although always am among an and another any anyone
anything are around as at back be became because been before behind being below between both but by can cannot could did do
does doing done down during each either else ever every few first for from further get give had has have having he her here
hers herself him himself his how however if in into is it its itself just last least less made make many may me might more
most much must my myself never next no nor not nothing now of off often on once one only or other others our ours ourselves
out over own per perhaps please put rather same see seem several she should since so some something still such take than
that the their theirs them themselves then there these they this those though through thus to together too toward under
until up upon us use used using very via was we well were what when where whether which while who whom whose why will with
within without would yet you your yours yourself yourselves
""".split()
