from inkstone.functions.dialects import Dialect
from inkstone.functions.normalize import NormalizerConfig, normalize, obfuscate_and_normalize
from inkstone.functions.obfuscate import ObfuscatorConfig, obfuscate, obfuscate_token_value
from inkstone.functions.tokens import tokenize

__all__ = ["Dialect", "NormalizerConfig", "ObfuscatorConfig", "normalize", "obfuscate", "obfuscate_and_normalize", "obfuscate_token_value", "tokenize"]
