"""From rules to DataFrames: normalisation, planning of bodies, fixpoints."""
