def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    cell = lambda x: "" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in pdf.itertuples(index=False, name=None))
