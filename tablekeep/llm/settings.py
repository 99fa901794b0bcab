"""Production parameters shared by the queries and the pipeline."""

from __future__ import annotations

import public_tokenizers

#: The installed vocabulary of the packed sequences; another path may be given to the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

#: Key of the surrogates. A user sets one of their own and keeps it secret.
SURROGATE_KEY = b"replace this key"
