from haulage.llm import licenses

APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
GPL = """/*
 * This program is free software%s you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation%s either version %d of the License, or
 * (at your option) any later version.
 */"""
BSD = """Copyright (c) 2020, Someone
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""


def test_standard_headers(spark):
    texts = [APACHE, MIT, GPL % (";", ";", 2), GPL % (":", ",", 3), BSD, "The licence of this text is unknown; all rights are reserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()]
    assert got == [
        "Apache-2.0,Apache-2.0-header",
        "MIT-text",
        "GPL-2.0,GPL-grant",
        "GPL-3.0,GPL-grant",
        "BSD,BSD-2-Clause,BSD-3-Clause,BSD-reserved,all-rights-reserved",
        "",
    ]
