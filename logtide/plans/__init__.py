"""Plan building blocks shared by the operators: reliable materialisation, size-checked
broadcasts, skew-proof ordering and trailing frames, exact quantiles."""
